"""Labelled documents for rule induction, made from a seed.

Each document is of one kind, or a mixture labelled with the kind that makes up
more than half of its non-blank characters.
"""

from __future__ import annotations

import base64
import random
import textwrap

ONSET = "b br c d dr f fl g gr h j k kl l m n p pr qu r s sh st t tr v w z".split()
VOWEL = "a e i o u ae ei ia eo ou".split()
CODA = ["", "l", "m", "n", "r", "s", "sk", "th", "x", "nd", "rk"]
NOUNS = """harbour letter engine meadow contract violin recipe planet nurse market window river archive student protein bridge castle debt goalkeeper poem
router theorem basket glacier pepper chorus statute tissue voltage colony""".split()
ADJECTIVES = "narrow quiet recent broad legal digital acute frozen northern loud careful ancient liquid common famous tidal".split()
VERBS = "noticed repaired described measured followed sold opened counted crossed painted moved studied remembered".split()
# Sentence frames of this module's own making; none of them is taken from a corpus that the rules are used on.
ENGLISH = [
    "After the {n} had been {v}, a {a} {n} was all that {N} could afford.", "Nobody told {N} why the {n} of {y} had to be {v} before the {n}.", "If you ask about the {n}, most people here will point to the {a} {n}.",
    "She kept the {n} in a {a} {n} and {v} it whenever {N} was away.", "They {v} {d} letters about the {n}, none of which {N} ever answered.", "Neither the {n} nor the {n} was as {a} as {N} had hoped.",
    "Since {y}, when the {n} was {v}, its {n} has belonged to {N}.", "“Where is the {a} {n}?” asked {N}. “I thought you had {v} it.”", "The rain stopped, the {n} was {v}, and everyone went back to the {n}.",
    "Of the {d} guests, only {d} had seen how the {n} was {v}.", "{N} would rather have {v} a {n} than explain the {n} to us.", "Although {a}, the {n} held up well until it was {v} in {y}.",
    "- Will the {n} be {v}? - Perhaps, but not while {N} is in charge.", "That a {n} can be {v} twice is something the {a} {n} of {N} had to learn.", "For {d} years it stood between a {n} and a {n}, and no one {v} it.",
]
GERMAN = [
    "Als {N} im Jahr {y} ankam, war {W} schon lange mit {W} verbunden.", "Niemand wusste, ob {W} aus {N} oder doch aus {W} stammte.", "Wer {W} kennt, der wird auch {W} und die {d} Briefe von {N} verstehen.",
    "Nach {d} Tagen kam {N} zurück und fand weder {W} noch {W}.", "Das alles hat {N} nie gestört, denn {W} war für sie nur ein Wort.", "Wir haben {W} gesehen, aber {N} sprach lieber von {W} als von uns.",
]
SPANISH = [
    "Cuando {N} llegó en {y}, ya no quedaba nada de {w} ni de {w}.", "A los {d} días se supo que {w} era más caro que {w}.", "Lo que dijo {N} sobre {w} no se parece en nada a {w}.", "Con {w} en la mano, {N} salió a buscar la casa de {w}.",
    "Aunque {w} fuera verdad, {N} no lo habría dicho por {w}.",
]
FRENCH = [
    "Quand {N} est arrivé en {y}, il ne restait rien de {w} ni de {w}.", "Au bout de {d} jours, on a su que {w} était plus cher que {w}.", "Ce que {N} disait de {w} ne ressemble pas du tout à {w}.", "Elle a pris {w} avec elle et {N} a gardé la clé de {w}.",
    "Même si {w} était vrai, {N} ne l'aurait pas dit pour {w}.",
]

PLAIN = ["I was not there when it was said.", "So be it, he said to me, and he did as I had.", "In {y} we had no way to do it but by {N}.", "It is up to you if she is to go or to be with us.", "As it was, no one but {N} had an eye on the {n}.", "“Do we go or not?” “We do, if he is up to it.”", "Is it as it was, or am I at an end?", "At six it was hot, and by {d} we had had it."]


def _name(r: random.Random) -> str:
    return "".join(r.choice(ONSET) + r.choice(VOWEL) + r.choice(CODA) for _ in range(r.choice((2, 2, 3)))).capitalize()


def _sentence(r: random.Random, forms: list[str], topic: list[str]) -> str:
    s = r.choice(forms)
    for key, make in (("{a}", lambda: r.choice(ADJECTIVES)), ("{n}", lambda: r.choice(NOUNS)), ("{v}", lambda: r.choice(VERBS)), ("{N}", lambda: _name(r)), ("{W}", lambda: r.choice(topic)), ("{w}", lambda: r.choice(topic).lower()), ("{y}", lambda: str(r.randint(1700, 2024))), ("{d}", lambda: str(r.randint(2, 9999)))):
        while key in s:
            s = s.replace(key, make(), 1)
    return s


def prose(r: random.Random, size: int) -> str:
    forms = r.choice([ENGLISH] * 4 + [GERMAN, SPANISH, FRENCH, PLAIN])
    topic = [_name(r) for _ in range(r.randint(2, 12))]
    if r.random() < 0.5:  # few forms, so much repeats
        forms = r.sample(forms, min(len(forms), r.randint(3, 6)))
    out: list[str] = []
    while sum(map(len, out)) < size:
        out.append(_sentence(r, forms, topic))
    if r.random() < 0.3:  # careless: typing errors, dropped and shouted words
        words = " ".join(out).split(" ")
        for i in range(len(words)):
            u = r.random()
            if u < 0.04:
                words[i] = words[i].upper()
            elif u < 0.08:
                words[i] = words[i][:-2] + words[i][-1:] if len(words[i]) > 3 else words[i]
            elif u < 0.11:
                words[i] = r.choice(NOUNS)
            elif u < 0.13:
                words[i] = words[i].replace("e", "Ã©")
        out = [" ".join(words)]
    form = r.randrange(5)
    if form == 0:
        return textwrap.fill(" ".join(out), r.choice((48, 60, 72, 80)))
    if form == 1:
        return "\n".join(out)
    if form == 2:
        return r.choice(("\n\n", "\r\n\r\n")).join(" ".join(out[i : i + 3]) for i in range(0, len(out), 3))
    if form == 3:
        return " ".join(s.replace(" the ", " the\t") for s in out) if r.random() < 0.4 else "  ".join(out)
    return " ".join(out)


def _entry(r: random.Random) -> str:
    f = r.randrange(6)
    if f == 0:
        return f"{r.choice(ADJECTIVES)} {r.choice(NOUNS)}, {_name(r)}"
    if f == 1:
        return f"{_name(r)} ({r.randint(1700, 2024)})"
    if f == 2:
        return f"{r.choice(NOUNS).capitalize()} and {r.choice(NOUNS)} {r.randint(1, 400)}"
    if f == 3:
        return f"{r.choice(NOUNS)} {_name(r)}"
    return f"{r.choice(ADJECTIVES)} {r.choice(NOUNS)}"


def listing(r: random.Random, size: int) -> str:
    form, out, i = r.randrange(9), [], 0
    mark = r.choice(("- ", "* ", "• ", "– ", "  + ", "# ", "o "))
    while sum(map(len, out)) < size:
        e, i = _entry(r), i + 1
        if form == 1:
            e = f"{i}{r.choice('.)')} {e}"
        elif form == 2:
            e += ", " + ", ".join(str(r.randint(1, 600)) for _ in range(r.randint(1, 5)))
        elif form == 3:
            e += ": " + _name(r)
        elif form in (4, 5):
            e = mark + e
        elif form == 6:
            e = r.choice("-*") + " " + (e.upper() if r.random() < 0.3 else e)
        out.append(e)
    if r.random() < 0.3:  # careless: shouted entries, stray letters
        out = [e.upper() if r.random() < 0.1 else e.replace(" ", f" {r.choice('aeltx')} ", 1) if r.random() < 0.25 else e for e in out]
    if form == 7:
        return r.choice((" · ", " / ", " | ", " • ", " > ", "; ")).join(out)
    return r.choice(("\n", "\n", "\n", "\n\n")).join(out)


def table(r: random.Random, size: int) -> str:
    form, cols, out = r.randrange(8), r.randint(3, 7), []
    while sum(map(len, out)) < size:
        cells = [_name(r) + (" " + r.choice(NOUNS) if r.random() < 0.3 else "") if out else r.choice(NOUNS)]
        cells += [r.choice((str(r.randint(1, 99999)), str(r.randint(1, 99999)), f"{r.random() * 99:.2f}", "n/a", "-", "", "x", r.choice(NOUNS))) if out else r.choice(NOUNS) for _ in range(cols - 1)]
        if form == 0:
            row = "| " + " | ".join(cells) + " |"
        elif form == 1:
            row = "\t".join(cells)
        elif form == 2:
            row = ",".join(cells)
        elif form == 3:
            row = ";".join(f'"{c}"' for c in cells)
        elif form == 4:
            row = " & ".join(cells) + " \\\\"
        elif form == 5:
            row = "".join(c[:18].ljust(20) for c in cells).rstrip()
        elif form == 6:
            row = "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
        else:
            row = ("! " if not out else "|-\n| ") + (" !! " if not out else " || ").join(cells)
        out.append(row)
    text = "\n".join(out)
    return f"<table>{text}</table>" if form == 6 else "{|\n" + text + "\n|}" if form == 7 else text


def junk(r: random.Random, size: int) -> str:
    form = r.randrange(12)
    if form == 0:
        return "".join(r.choice("~|+{}/;:\\!_^*%[]&=@<>-#$? ") for _ in range(size))
    if form == 1:
        raw = base64.b64encode(r.randbytes(size * 3 // 4)).decode()
        return "\n".join(raw[i : i + 72] for i in range(0, len(raw), 72)) if r.random() < 0.7 else raw
    if form == 2:
        return "\n".join(f"{i:08x}  " + " ".join(f"{b:02x}" for b in r.randbytes(16)) for i in range(r.randrange(1 << 20) & ~15, 1 << 21, 16)[: max(2, size // 58)])
    if form == 3:
        return "".join(r.choice((f"%{r.randrange(128, 256):02X}", f"%{r.randrange(128, 256):02X}", r.choice("abcXYZ019+"))) for _ in range(size // 3))
    if form == 4:
        return "".join(r.choice(("Ã©", "Ã¼", "ÃŸ", "â€™", "�", "Â\xa0", " ", _name(r)[:3])) for _ in range(size // 2))
    if form == 5:
        return "".join(f"{_name(r)[:4].lower()}.{r.choice('abcz')}{r.randint(1, 99)}{{{r.choice(('pad', 'margin', 'top'))}:{r.randint(1, 900)}px;{r.choice(('bg', 'fill'))}:#{r.randrange(1 << 24):06x}}}" for _ in range(size // 36 + 1))
    if form in (6, 11):  # letters torn apart
        out, wrong, gap = [], r.uniform(0.06, 0.35), r.uniform(0.15, 0.6)
        for c in prose(r, size // 2):
            out.append(r.choice("|^~`'!.;1") if r.random() < wrong else c)
            if r.random() < gap:
                out.append(" ")
        return "".join(out)
    if form == 7:  # words without sentences
        stock = NOUNS + [_name(r).lower() for _ in range(r.choice((20, 100, 300)))]
        words = [r.choice(stock) + (r.choice("*}{|@^:#[]") if r.random() < 0.06 else "") for _ in range(size // 7)]
        return " ".join(words)
    if form == 8:
        line = f"{_name(r)} {_name(r).lower()} {r.randint(1, 999)}"
        return r.choice(("\n", " ", "")).join([line] * (size // len(line) + 3))
    if form == 9:
        line = _sentence(r, ENGLISH, [_name(r)])
        return r.choice(("\n", " ")).join([line] * (size // len(line) + 5))
    return " ".join("".join(r.choice("bcdfghjklmnpqrstvwxz0123456789") for _ in range(r.randint(3, 14))) for _ in range(size // 9))


MAKERS = {"prose": prose, "list": listing, "table": table, "junk": junk}


def labelled(per_kind: int = 500, seed: int = 3) -> list[tuple[str, str]]:
    """(label, text) of 4 * per_kind documents, a third of them mixtures."""
    r, out = random.Random(seed), []
    for label, make in MAKERS.items():
        for _ in range(per_kind):
            size = int(r.choice((120, 300, 600, 1000, 2000)) * r.uniform(0.7, 1.3))
            if r.random() < 0.67:
                text = make(r, size)
            else:  # the label's kind and another, the other with less than half
                other = "prose" if label != "prose" else r.choice(("list", "table", "junk"))
                part = r.uniform(0.05, 0.42)
                two = [make(r, int(size * (1 - part))), MAKERS[other](r, int(size * part))]
                own, small = (len("".join(t.split())) for t in two)
                if small > 0.45 * (own + small):
                    continue
                if r.random() < 0.6 or label == "prose":
                    two.reverse()
                text = r.choice(("\n\n", "\n", "\r\n\r\n")).join(two)
            out.append((label, text))
    return out
