"""Template residue, filler text and error pages.

Three grammars are applied to a document's own content, i.e. to what is left
after comments, drafts switched off and macro definitions are cut:

* slots: one grammar per delimiter. Three things speak for a slot: its words (a prompt
  or a field name; how many must be is stricter for delimiters that ordinary text uses
  too), its form (padding, identifiers with underscores, several capitalised words
  between delimiters that text has no use for) and its place (the whole of a title, an
  author, a caption). Bare markers count only where they fill a whole unit.
* filler: pseudo-Latin by density, filler commands, self-describing sample
  sentences and words repeated without end.
* whole-page messages: a text without any structure of an article whose sentences are
  notices, by the share of the text that they make up, so an article that quotes one is
  none. A notice is told by stock phrases, by forms (status lines, stack traces, fields of
  a record), or in a short text by what it is about and what is wrong or to be done.

Code blocks, verbatim text, quotations and typewriter text are context in which
such things are shown and not meant; they are cut before slots are sought.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that field names of templates are made of, and words that ask for
# something to be put in, in English, German, French, Spanish, Italian, Portuguese, Dutch, Polish and Russian.
FIELD_WORDS = frozenset(
    """title author authors name names firstname lastname affiliation institution email address abstract summary text body content section paragraph
    introduction intro discussion method methods results conclusion caption figure table reference references bib bibliography entry journal year keyword keywords
    date placeholder heading subtitle acknowledgements acknowledgments template dummy
    titel autor autors autorin zusammenfassung abschnitt absatz einleitung literatur bildunterschrift platzhalter überschrift
    titre auteur nom résumé texte paragraphe légende référence
    título titulo nombre resumen texto párrafo sección referencia leyenda
    titolo autore autori nome riassunto sommario testo paragrafo sezione didascalia riferimento
    autores resumo parágrafo seção secção legenda referência
    auteurs naam samenvatting tekst alinea bijschrift
    tytuł imię nazwisko streszczenie tekst akapit podpis
    название заголовок автор автора имя фамилия аннотация текст раздел абзац подпись""".split()
)
PROMPT_WORDS = frozenset(
    """insert write describe enter type fill filled todo tbd here
    einfügen eingeben hier folgt ergänzen insérer ici compléter rédiger écrire saisir insertar aquí aqui pendiente escriba escribir rellenar completar
    inserire inserisci scrivere scrivi qui inserir insira escreva preencher invoegen invullen voeg wstaw wpisz tutaj вставьте введите вставить ввести здесь укажите""".split()
)
CORE_WORDS = FIELD_WORDS | PROMPT_WORDS
#: Prompts of scripts that set no blanks between words.
UNSPACED = re.compile("ここに|を入力|を記入|を挿入|请输入|請輸入|在此|此处|此處|여기에|입력하세요|입력하십시오")
LINK_WORDS = frozenset(
    """a an the of this that to be in at on for and or your my goes go is one two three first second last full short main most least words word up short
    start writing add put paper article thesis document number no new more longer
    der die das des dem den ein eine ihr ihre ihren name vorname nachname von für noch
    le la les l de du des un une votre prénom à a
    el del su sus un una por de los las primer
    il lo gli i di dell della tuo tua un una o os do da dos das seu sua uw de het een w na""".split()
)
# The usual pseudo-Latin vocabulary.
LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisci elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam
    quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur
    excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum pellentesque habitant morbi tristique senectus netus malesuada
    fames turpis egestas curabitur vestibulum vivamus praesent vel ut et ex ea ac at in non eu id est""".split()
)
LATIN_STRONG = LATIN - frozenset("in et a at est non sit sed ut ex ea ac id eu vel sunt anim".split())

WORD = re.compile(r"[^\W\d_]+|\d+")
COMMENT = re.compile(r"%(?<!\\%)[^\n]*")
SWITCHED_OFF = re.compile(r"\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)|\\iffalse\b.*?(?:\\fi\b|\Z)", re.S)
INSIDE = r"(?:(?!\n\s*\n)[^%s])*+"  # a quotation ends with its paragraph at the latest
SHOWN = re.compile(
    r"\\begin\{(verbatim\*?|lstlisting|minted|Verbatim|alltt|filecontents\*?|code|listing)\}.*?(?:\\end\{\1\}|\Z)|\\verb\*?([^\w\s*]).*?\2|\\lstinline([^\w\s]).*?\3"
    r"|\\(?:texttt|url|code|lstinline)\{[^{}]*\}|```.*?(?:```|\Z)|``" + INSIDE % "`'\"" + r"(?:'(?!')" + INSIDE % "`'\"" + r")*+(?:''|\")|“" + INSIDE % "”" + "”|„" + INSIDE % "“”" + "[“”]|\"`(?:(?!\\n\\s*\\n)[^\"])*+\"(?<=')|\"`(?:(?!\\n\\s*\\n|\"').)*+\"'", re.S
)
DEFINED = re.compile(r"(?m)^\s*\\(?:re|provide)?(?:newcommand|def|newenvironment|DeclareMathOperator|renewcommand|providecommand|let)\b\*?.*$")
ESCAPED = re.compile(r"\\([_{}$#&%])")
ANGLE = re.compile(r"\$\s*\\langle\s*\$|\$\s*\\rangle\s*\$|\\textless\b\s*(?:\{\})?|\\textgreater\b\s*(?:\{\})?")

B = r"([^\n{}\[\]<>()$\\@*?|=]++)"
#: (pattern, least share of known words, whether a core word is needed, form that speaks for itself).
#: Patterns begin with the delimiter, lookbehinds follow it: the search can skip to it then.
IDENTIFIER = re.compile(r"[^\W\d_]{3,}(?:_[^\W\d_]{3,})+")
CAPITALS = re.compile(r"[^\W\d_]{3,}(?: (?:[^\W\d_]+))+")
SLOTS = [
    (re.compile(r"\{\{(\{*+\s*+" + B[1:-1] + r"\s*+)\}\}"), 0.6, True, "padded"),
    (re.compile(r"\[\[\s*+" + B + r"\s*+\]\]"), 0.6, True, "words"),
    (re.compile(r"<<\s*+" + B + r"\s*+>>"), 0.6, True, "words"),
    (re.compile(r"@@\s*+" + B + r"\s*+@@"), 0.5, False, "words"),
    (re.compile(r"\*\*\*\s*+" + B + r"\s*+\*\*\*"), 0.6, True, ""),
    (re.compile(r"\(\(\s*+" + B + r"\s*+\)\)"), 0.6, True, ""),
    (re.compile(r"__(?<![^\W_]__)_*+\s*+([^\W_](?:(?!__)[^\n{}\[\]<>()$\\@*?|=])*+)__++(?![^\W_])"), 0.6, True, ""),
    (re.compile(r"[$#]\{\s*+" + B + r"\s*+\}"), 0.6, True, "identifier"),
    (re.compile(r"\?{3,}+\s*+" + B + r"\s*+\?{3}"), 0.5, False, ""),
    (re.compile(r"%%\s*+" + B.replace("=]", "=%]") + r"\s*+%%"), 0.6, True, "identifier"),
    (re.compile(r"\[\s*+(?:\.\.\.|…|\\dots|\\ldots)\s*+\]\s*+" + B + r"\s*+\[\s*+(?:\.\.\.|…|\\dots|\\ldots)\s*+\]"), 0.9, True, ""),
    (re.compile(r"\{\\(?:bf|it|em|bfseries|itshape)\s*+\[\s*+" + B + r"\s*+\]\}|\\(?:textbf|textit|emph)\{\s*+\[\s*+" + B + r"\s*+\]\s*+\}"), 0.75, True, "capitals"),
    (re.compile(r"\\(?:textit|emph|textbf|textsl)\{\s*+\(\s*+" + B + r"\s*+\)\s*+\}"), 0.75, True, ""),
    (re.compile(r"\\todo(?:\[[^\]]*\])?\{\s*+" + B + r"\s*+\}"), 0.9, True, ""),
    (re.compile(r"\[(?<![\w\\}\]\[]\[)\s*+" + B + r"\s*+\](?![\]({])"), 0.9, True, "capitals"),
    (re.compile(r"<(?<![\w<\\]<)\s*+([^\W\d][^\n{}\[\]<>()$\\@*?|=/]++)\s*+>(?!>)"), 0.9, True, "titled"),
    (re.compile(r"\$([A-Z]{3,}(?:_[A-Z]{3,})+)\$"), 0.0, False, "identifier"),
    (re.compile(r"\{(?<![\w\\}\]^_$*]\{)([a-z]{3,}(?:_[a-z]{3,})+)\}(?![{\[])"), 2.0, True, "identifier"),
]
#: The whole of a field: a prompt in it, or a field's name alone, stands where the author's own words should.
FIELD = re.compile(r"\\(title|author|date|affiliation|affil|institute|institution|address|email|thanks|caption|keywords|subtitle|section|subsection|paragraph)\*?(?:\[[^\[\]]*\])?\{\s*+" + B + r"\s*+\}")
UNIT = r"(?:^|(?<=[\n{}])|(?<=\\and )|(?<=[.!?] )|(?<=[.!?]\n)|(?<=\] ))\s*"
END = r"\s*(?=$|[\n}]|\\and\b|\s[A-ZÀ-Þ])"
BARE = re.compile(
    UNIT + r"(?:TBD|TBA|T\.B\.D\.|TODO(?::[^\n.}]*+)?|FIXME(?::[^\n.}]*+)?|to be (?:written|added|filled in|completed|done|determined)|coming soon|[xX]{3}(?:\s+[xX]{3})+|[xX]{5,}"
    r"|\(?\s*(?:placeholder|platzhalter)\s*\)?|(?:click|tap)(?: or (?:tap|click))? here to (?:enter|add) \w+|(?:your|insert) (?:text|title|name|abstract|content) (?:goes )?here)\.?" + END, re.I | re.M
)
COMMANDS = re.compile(r"\\(?:lipsum|blindtext|Blindtext|blinddocument|Blinddocument|blindlist\w*|blinditemize|blindenumerate|kant|unpacklipsum|setlipsum|lorem|zw?blindtext)\b\s*(?:\[|\n|\\|\.|\s|$|\*|\{)")
SAMPLE = re.compile(
    r"(?:\b(?:item|line|sentence|word|paragraph|entry|point|section) (?:one|two|three|four|five|six|[A-F]|\d+) of the (?:example|sample|dummy) text\b"
    r"|\bthis is (?:a |some )?(?:sample|dummy|example|placeholder|filler|blind|test) (?:text|paragraph|sentence)\b|\bmore (?:dummy|sample|filler|example) text follows\b"
    r"|\bhas no meaning and only fills\b|\bonly fills? the space\b|\bnothing in these lines is meant to be read\b|\bonly show the width of the (?:column|page|line)\b|\breplace (?:it|this(?: text)?) before you submit\b"
    r"|\bthe quick brown fox jumps over the lazy dog\b"
    r"|\b(?:dies|das|hier) ist (?:ein |nur ein )?(?:blindtext|platzhaltertext|beispieltext|fülltext)\b|\bder (?:satz|absatz) .{0,30}des beispieltextes\b"
    r"|\b(?:ceci est|voici) (?:un |du )?(?:faux texte|texte (?:d'exemple|de remplissage|factice))\b|\b(?:este es|esto es) (?:un )?texto (?:de (?:ejemplo|relleno|prueba)|simulado)\b)", re.I
)
REPEATED = re.compile(r"\b([^\W\d_]{2,12})\b(?:[\s,]+\1\b){7,}", re.I)
RUN = re.compile(r"[^.!?\n{}\\]+")


def _plain(text: str) -> str:
    """Repairs UTF-8 that was read as a one-byte encoding, and odd blanks."""
    if "Ã" in text or "Â" in text:
        text = re.sub("[\u00a0-\u00ff]{2,}", lambda m: _decoded(m.group()), text)
    return text.replace("\r\n", "\n").replace("\r", "\n").replace("\xa0", " ").replace("\xad", "").lstrip("\ufeff")


def _decoded(s: str) -> str:
    try:
        return s.encode("latin-1").decode("utf-8")
    except UnicodeError:
        return s


def own_content(text: str) -> str:
    """The text without comments, drafts switched off, and macro definitions."""
    text = COMMENT.sub("", text)
    text = SWITCHED_OFF.sub("\n", text)
    end = text.find("\\end{document}")
    if end >= 0:
        text = text[:end]
    return DEFINED.sub("", text)


def _words(body: str) -> list[str]:
    return [w.lower() for w in WORD.findall(body.replace("_", " ").replace("-", " "))]


def _reads_like_a_slot(body: str, least: float, core: bool) -> bool:
    if UNSPACED.search(body):
        return True
    words = _words(body)
    if not words or all(w.isdigit() for w in words):
        return False
    if len(words) > 15:  # instructions may be long, names of fields aren't
        return words[0] in PROMPT_WORDS or words[0] in ("please", "bitte", "veuillez", "por") and bool(PROMPT_WORDS & set(words[:4]))
    known = sum(w in CORE_WORDS or w in LINK_WORDS or w.isdigit() for w in words)
    return known >= least * len(words) and (not core or any(w in CORE_WORDS for w in words))


def _has_form(body: str, form: str) -> bool:
    """Whether a slot's form alone speaks for it."""
    inner = body.strip().strip("{}").strip()
    if form == "padded":  # {{ some name }}, {{some_name}}; braces without padding protect capitals in references
        padded = body.strip("{}")
        return bool(IDENTIFIER.fullmatch(inner)) or padded[:1].isspace() and padded[-1:].isspace() and bool(re.fullmatch(r"[^\W\d_]+(?:[ _.|-][^\W\d_]+)*+", inner))
    if form == "identifier":
        return bool(IDENTIFIER.fullmatch(inner))
    if form == "words":
        return bool(IDENTIFIER.fullmatch(inner))
    if form == "capitals":  # [FUNDING AGENCY]
        long = [w for w in inner.split() if w.lower() not in LINK_WORDS]
        return inner.isupper() and bool(CAPITALS.fullmatch(inner)) and min(map(len, long), default=0) >= 4 and max(map(len, long)) >= 6  # abbreviations are short
    if form == "titled":  # <Corresponding Author Name>
        return bool(CAPITALS.fullmatch(inner)) and all(w[:1].isupper() for w in inner.split())
    return False


def _field(kind: str, body: str) -> bool:
    words = _words(body)
    if UNSPACED.search(body):
        return True
    if not words or len(words) > 15 or not all(w in CORE_WORDS or w in LINK_WORDS for w in words):
        return False
    if any(w in PROMPT_WORDS for w in words) and any(w in FIELD_WORDS for w in words):
        return True
    return kind in ("title", "author", "affiliation", "affil", "institute", "institution", "address", "email") and len(words) <= 3 and all(w in FIELD_WORDS or w in ("first", "second", "your", "full", "paper", "article") for w in words)


def slot(text: str) -> str | None:
    """The first unfilled slot of a document's own content (see own_content)."""
    text = SHOWN.sub(" ", text)
    text = ANGLE.sub(lambda m: ">" if "rangle" in m.group() or "greater" in m.group() else "<", text)
    text = ESCAPED.sub(r"\1", text)
    for pattern, least, core, form in SLOTS:
        for m in pattern.finditer(text):
            body = next(g for g in m.groups() if g)
            if m.group()[0] == "<" and f"</{body.strip().split()[0].lower()}" in text.lower():
                continue  # a tag pair
            if _reads_like_a_slot(body, least, core) or form and _has_form(body, form):
                return m.group()
    for m in FIELD.finditer(text):
        if _field(m.group(1), m.group(2)):
            return m.group()
    m = BARE.search(text)
    return m.group().strip() if m else None


def filler(text: str) -> str | None:
    """The first filler text of a document's own content."""
    text = SHOWN.sub(" ", text)
    m = COMMANDS.search(text) or SAMPLE.search(text) or REPEATED.search(text)
    if m:
        return m.group().strip()
    if "ipsum" in text.lower() or "adipiscing" in text.lower() or "dolor" in text.lower():
        for m in RUN.finditer(text):
            words = [w.lower() for w in WORD.findall(m.group())]
            if len(words) >= 4 and sum(w in LATIN for w in words) >= 0.6 * len(words) and len(set(words) & LATIN_STRONG) >= 3:
                return m.group().strip()[:80]
    return None


# What error pages and script notices say, in four languages.
MESSAGE = re.compile("".join(line.strip() for line in r"""\b(?:[45]\d\d)\b.{0,12}(?:not found|bad gateway|gone|forbidden|unavailable|too many requests|internal|error|unauthori|time-?out|denied|bad request)
    |\b(?:http|error|status|fehler|erreur)\W{0,6}[45]\d\d\b|^\W*(?:error|oops|we are sorry|sorry|something went wrong|access denied|forbidden|page not found|not found|bad gateway|service unavailable|internal server error|down for maintenance|too many requests|request timed out|timed out|session expired|nosuchkey|slowdown|accessdenied)\b
    |page (?:was |could )?not (?:be )?found|moved or no longer exists|link you followed|did not answer in time|went wrong|could not be (?:located|found|reached)|no such (?:object|file|key)|unexpected (?:condition|error)
    |do(?:es)? not have permission|sign in to continue|session (?:has )?(?:ended|expired)|try again (?:later|in)|please try again|wait \d+ seconds|being upgraded|under maintenance|down for maintenance|connection (?:failed|refused|timed out|reset)|database connection
    |(?:conversion|compilation|processing) of the .{0,30} failed|no output was made|timed? ?out|write to the administrator|contact (?:the|your) administrator|return to the home ?page|home page|search(?:ing)? instead|generated by|reference id|incident|ray id|request id|requestid
    |java ?script|\bscripts?\b|\bscripting\b|\bnoscript\b|\bjs\b|does not run the code|cookies?\b|enable|newer browser|your browser|reload|refresh this page|turn it on|once this is done|changing the setting|will be shown once|checking your browser|loading .*\.\.\.|nothing appears
    |traceback \(most recent|^\s*file ".*", line \d+|\b\w{1,60}error\b|exception\b|latex error|emergency stop|job aborted|no pages of output|transcript written|type x to quit|enter new name|default extension|^l\.\d+|fatal error|segmentation fault|stack trace|^\s*at [\w.$]+\(
    |nicht gefunden|verweigert|nicht erreichbar|keine berechtigung|versuchen sie|zurück zur|zurzeit|aktivieren sie|erlaubt sein|führt keine skripte|skripte?\b|laden sie|nötig|antwortete nicht|wartung|fehler
    |introuvable|accès refusé|refusé|indisponible|n'existe pas|n'a pas répondu|réessayez|retour à|veuillez|rechargez|nécessaires|activer|maintenance|erreur|autorisation|n'exécute pas|droits
    |no encontrad|denegado|no disponible|no existe|no respondió|inténtelo|vuelva a|volver al|active|recargue|permitir|necesita|permiso|mantenimiento|no ejecuta|error del
    |["']?(?:status|message|detail|code|error|host ?id|resource)["']?\s*:""".splitlines()), re.I | re.M)
#: What a notice of a short page is about, and what is wrong or to be done, in several languages and scripts.
ABOUT = re.compile(r"""(?i)\b(?:page|resource|site|web ?site|server|link|url|browser|request(?:ed)?|connection|file|document|content|access|account|session|service|application|certificate|gateway|host|domain
    |seite|ressource|verbindung|anfrage|datei|inhalt|zugriff|sitzung|dienst|anwendung|dokument|lien|serveur|navigateur|requête|connexion|fichier|contenu|accès|compte|adresse|demandée?
    |página|recurso|sitio|servidor|enlace|navegador|solicitud|conexión|archivo|contenido|acceso|cuenta|sesión|servicio|documento
    |pagina|risorsa|sito|collegamento|richiesta|richiesto|connessione|contenuto|accesso|sessione|servizio|ligação|conexão|arquivo|conteúdo|acesso|conta|sessão|serviço|solicitad[ao]
    |bron|verbinding|verzoek|bestand|toegang|strona|zasób|serwer|połączenie|plik|dostęp)\b|страниц|ресурс|сайт|сервер|ссылк|браузер|запрос|соединени|файл|доступ|документ|ページ|リソース|サイト|サーバ|リンク|ブラウザ|リクエスト|接続|ファイル|アクセス|页面|頁面|网站|網站|资源|服务器|伺服器|链接|浏览器|请求|文件|페이지|서버|브라우저|사이트|링크""".replace("\n    ", ""))
WRONG = re.compile(r"""(?i)\b(?:removed|deleted|moved|expired|denied|blocked|disabled|missing|invalid|unavailable|not (?:be )?(?:found|available|exist|allowed|permitted|supported|possible|loaded|displayed)|cannot|can't|could not|couldn't|unable|failed|forbidden|refused|error|go back|back to|return to|try again|retry|reload|refresh|enable|allow|contact|sign in|log in|required|must be
    |entfernt|gelöscht|verschoben|abgelaufen|gesperrt|ungültig|fehlt|nicht|konnte|fehlgeschlagen|zurück|erneut|anmelden|supprimée?|déplacée?|expirée?|refusée?|bloquée?|invalide|introuvable|indisponible|impossible|échec|retour|revenir|revenez|réessayer|contactez|connectez|n'a pas|n'est pas|n'existe
    |eliminad[ao]|borrad[ao]|movid[ao]|caducad[ao]|denegad[ao]|bloquead[ao]|inválid[ao]|no (?:se |está |existe|fue|pudo|encontr)|imposible|error|volver|regrese|vuelva|intente|inténtelo|inicie sesión|contacte
    |rimoss[ao]|eliminat[ao]|spostat[ao]|scadut[ao]|negat[ao]|bloccat[ao]|non (?:è|esiste|trovat[ao]|disponibile|può|riesce)|impossibile|errore|torna|tornare|riprova|riprovare|accedi|contatta|removid[ao]|excluíd[ao]|expirad[ao]|negad[ao]|não (?:foi|está|existe|encontr|é|pode)|impossível|erro|voltar|volte|tente|contate
    |verwijderd|verplaatst|verlopen|geweigerd|niet|terug|opnieuw|usunięt[ay]|przeniesion[ay]|nie (?:można|istnieje|znaleziono)|wróć|spróbuj)\b|не (?:найден|удал|существ|доступ|может)|удален|удалён|перемещ|истек|истёк|запрещ|отказ|ошибк|вернит|вернуться|повтор|попробуйте|включите|見つかりません|ありません|できません|削除|移動|エラー|戻|失敗|有効|再|找不到|不存在|无法|無法|已删除|错误|返回|失败|重试|启用|찾을 수|없습니다|오류|돌아|다시""".replace("\n    ", ""))
#: Lines that make a short page a notice though it says other things too: an error's title or status, or that scripts are wanted.
STATUS = re.compile(r"(?i)^\W*(?:(?:http|error|status|fehler|erreur)\W{0,6})?[45]\d\d\b[^.]{0,40}$|^\W*(?:error|we are sorry|sorry|oops|access denied|accessdenied|forbidden|page not found|not found|bad gateway|service unavailable|internal server error|session expired|request timed out|nosuchkey|slowdown)\W*$|^\W*(?:error|fehler|erreur)\W{1,3}[45]\d\d\W*$")
SCRIPTS = re.compile(r"(?i)java ?script|\bscripts?\b|\bscripting\b|\bjs\b|\bskripte?\b|скрипт|スクリプト|脚本|스크립트|\byour browser\b|\b(?:su|tu) navegador\b|\bvotre navigateur\b|\bihr browser\b")
WANTED = re.compile(r"(?i)\b(?:enabled?|allow|needs?|required?|requires|disabled|turn(?:ed)? (?:it )?(?:on|off)|switched o(?:n|ff)|(?:does|do) not (?:run|support)|blocks?|aktivier|erlaub|nötig|benötigt|deaktiviert|activ[ae]|activer|permit|autoris|necesit|nécess|désactivé|habilit|attiv|richie[ds])|включ|требу|отключ|有効|無効|必要|启用|需要|禁用")
#: Up to so many characters a page without an article's structure can be a notice by what it says; longer ones must use stock phrases.
SHORT = 600
SENTENCE = re.compile(r"(?<=[.!?;])\s+(?=[^\W\d_a-zß-öø-ÿа-я]|[¿¡\"'])|(?<=[。！？])")
CHROME = re.compile(r"^\W*(?:skip to .*|sign in|log ?in|menu|search|home|help|about|contact|privacy(?: policy)?|browse|[\w ]{2,20}(?:\s*\|\s*[\w ]{2,20})+)\W*$", re.I)
TAG = re.compile(r"<[^<>]*>")
WRAPPER = re.compile(r"\\documentclass(?:\[[^\]]*\])?\{[^{}]*\}|\\(?:begin|end)\{document\}|\\usepackage(?:\[[^\]]*\])?\{[^{}]*\}|\\maketitle")
ARTICLE = re.compile(r"\\(?:section|subsection|chapter|cite[pt]?|bibitem|caption|bibliography|paragraph|eqref|ref|title|author|input|begin\{(?:abstract|equation|align|figure|table|theorem|proof|itemize|enumerate)\*?\})|\$[^$\n]+\$")


def whole_message(text: str, title: str | None = None, least: float = 0.6) -> str | None:
    """What marks the whole text as an error message or scripts notice, if it is one.

    The share of characters in sentences that are messages must reach ``least``;
    page furniture and a leading title line don't count either way.
    """
    if ARTICLE.search(text):
        return None
    x = WRAPPER.sub("\n", text)
    if x.lstrip()[:1] in "{[":  # fields of a record
        x = x.replace('",', '"\n')
    noscript = "<noscript" in x.lower()
    x = re.sub(r"(?i)</(?:p|h\d|title|head|div|code|message|detail|requestid|hostid|li|td|tr)>|<br\s*/?>", "\n", x)
    x = TAG.sub(" ", x)
    lines = [s.strip() for line in x.split("\n") for s in SENTENCE.split(line) if s.strip()]
    if not lines:
        return None
    short = sum(map(len, lines)) <= SHORT
    # what the page is about must be said once, what is wrong or to be done in most sentences
    topic = short and any(ABOUT.search(s) and WRONG.search(s) for s in lines)
    if short and len(lines) <= 6 and any(STATUS.search(s) or SCRIPTS.search(s) and WANTED.search(s) for s in lines):
        least = min(least, 0.2)
    said = own = 0
    first = None
    for i, s in enumerate(lines):
        if CHROME.match(s):
            continue
        if MESSAGE.search(s) or topic and WRONG.search(s):
            said += len(s)
            first = first or s
        elif i or len(lines) == 1:
            if title and s.strip() == title.strip():
                continue
            own += len(s)
        elif not re.search(r"[.!?]$", s):
            continue  # a title line
        else:
            own += len(s)
    return first if first and (said >= least * (said + own) or noscript and said) else None


def find(text: str | None, title: str | None = None) -> tuple[str, str] | None:
    """(kind, evidence) where the text is residue: kind slot, filler or message."""
    if not text or not text.strip():
        return None
    text = _plain(text)
    content = own_content(text)
    m = whole_message(content, title)
    if m:
        return "message", m[:120]
    m = slot(content)
    if m:
        return "slot", m[:120]
    m = filler(content)
    return ("filler", m[:120]) if m else None


def residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = "title") -> DataFrame:
    """(doc_id, kind, evidence) of every record that is or holds template residue.

    Null, empty and blank texts and commented-out text are no cases; rows with
    repeated ids each count; an empty table gives no rows. Whole texts are
    read, in one pass without a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            got = [find(t, n) for t, n in zip(d["text"], d["title"])]
            keep = [g is not None for g in got]
            if not any(keep):
                continue
            out = d.loc[keep, ["doc_id"]]
            yield out.assign(kind=[g[0] for g in got if g], evidence=[g[1] for g in got if g])

    title = F.col(title_col) if title_col else F.lit(None).cast("string")
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), title.alias("title")).where("text is not null")
    return x.mapInPandas(run, "doc_id long, kind string, evidence string")


def without_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = "title") -> DataFrame:
    """The records that hold none."""
    bad = residue(docs, id_col, text_col, title_col).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(bad, id_col, "left_anti")
