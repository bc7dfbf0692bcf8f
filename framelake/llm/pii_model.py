"""What the personal data operator learns: features of candidate spans, made-up candidates, boosted trees, thresholds.

There are no labels for personal data, so the trees learn from texts made by rules (`made_texts`) in which it is known what
is planted and what only looks alike: dates, versions, prices, order numbers, book numbers, checksums that fail, "at" in
plain sentences. A candidate counts as right if it is exactly what was planted. A part of the texts fits the trees, another
calibrates their margins (Platt) and sets each kind's threshold: the least probability from which so large a share of the
candidates is right. Everything is small and made on the driver, whatever the tables hold.
"""

from __future__ import annotations

import functools
import random
import re
from dataclasses import dataclass

import numpy as np

from .boosting import Trees, boost, platt

KINDS = ["email", "ip", "card", "phone"]
BRACKETED_AT = r"(?:[ \t]?[\[({<][ \t]?(?:at|AT|@)[ \t]?[\])}>][ \t]?|[ \t]@[ \t]?|@[ \t])"
BRACKETED_DOT = r"[ \t]?[\[({][ \t]?(?:dot|DOT|punkt|point|punto|\.)[ \t]?[\])}][ \t]?"
WORD_DOT = r"[ \t](?:dot|DOT|punkt|point|punto)[ \t]"
PLAIN_DOT = r"[ \t]?\.(?=[A-Za-z0-9])"
LOCAL, LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++", "[A-Za-z0-9-]++"
IP_DOT = r"(?:[ ]?[\[(][ ]?(?:\.|dot)[ ]?[\])][ ]?|[ ]\.[ ]|[ ]dot[ ]|\.)"
GROUP = r"(?:\([0-9]{1,6}+\)|[0-9]{1,12}+)"
#: What stands between the groups of a number, dashes of all widths and hard spaces included.
GAP = r" \u00a0./\u2010-\u2015-"
#: A word that may hold lines or dashes, up to the next `_at_`; and one letter of a word that is spelled with spaces.
LINED = "[A-Za-z0-9.%+]++(?:[_-](?!(?:at|AT|At)[_-])[A-Za-z0-9.%+]++)*+"
SPELLED = "[A-Za-z0-9](?: [A-Za-z0-9-](?![A-Za-z0-9]))*+"
#: Generators of candidates besides the base patterns. Much that looks alike is proposed, and what they find overlaps.
GENERATORS = [
    ("email", rf"{LOCAL}{BRACKETED_AT}{LABEL}(?:(?:{BRACKETED_DOT}|{WORD_DOT}|{PLAIN_DOT}){LABEL})++"),
    ("email", rf"{LOCAL}[ \t](?:at|AT)[ \t]{LABEL}(?:(?:{BRACKETED_DOT}|{WORD_DOT}){LABEL})++"),
    ("email", rf"{LOCAL}[ \t](?:at|AT)[ \t]{LABEL}(?:{PLAIN_DOT}{LABEL})++"),
    ("email", rf"(?<![A-Za-z0-9.%+_-]){LINED}[_-](?:at|AT|At)[_-][A-Za-z0-9]++(?:(?:[_-](?:dot|DOT|Dot)[_-]|\.)[A-Za-z0-9]++)++(?![A-Za-z0-9_-])"),
    ("email", rf"(?<![A-Za-z0-9._%+@-])(?<!(?<![A-Za-z0-9])[A-Za-z0-9._+-] )[A-Za-z0-9](?: [A-Za-z0-9._+-](?![A-Za-z0-9]))*+ @ {SPELLED}(?: \. {SPELLED})++"),
    ("ip", rf"(?<![0-9A-Za-z.:])[0-9]{{1,3}}+(?:{IP_DOT}[0-9]{{1,3}}+){{3}}(?![0-9A-Za-z]|\.[0-9])"),
    ("ip", r"(?<![0-9A-Za-z.:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}+|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}+){1,6}+)(?![0-9A-Za-z:])"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[ \u00a0._/\u2010-\u2015-]{0,3}+[0-9]){12,18}+(?![0-9A-Za-z])"),
    ("phone", rf"(?<![0-9A-Za-z+(./-]){GROUP}(?:(?:[{GAP}]{{1,3}}+|(?<=\))){GROUP}){{1,6}}+(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z+(./-])[0-9]{7,15}+(?![0-9A-Za-z])"),
]
#: Digits that a number of the kind can have.
DIGITS = {"card": (13, 19), "phone": (7, 15)}
#: Code points of context that are looked at, before and after.
BEFORE, AFTER = 32, 16
LINK = r"(?:[ :]+(?:is|us|me|at|on|to|no|number|nr|ist|est|es|unter|au|al|or|address|adresse))*[^A-Za-z0-9]*$"
CUES = {
    "email": "e-?mail|mail|contact|write|writing|reach|courriel|correo|contacto|kontakt|schreib[a-z]*|send|escrib[a-z]*|questions", "ip": "ip|ipv4|ipv6|host|server|from|client|gateway|dns|ping|address|adresse|login",
    "card": "card|visa|mastercard|amex|payment|cc|credit|karte|carte|tarjeta|kreditkarte|paid", "phone": "phone|number|nr|num|numero|nummer|call|tel|telephone|mobile|fax|cell|ring|whatsapp|telefon|handy|anruf[a-z]*|appel[a-z]*|llam[a-z]*|mobil|ruf[a-z]*|dial",
}
OTHERS = "version|ver|v|isbn|issn|order|part|page|pages|pp|chapter|section|sec|serial|invoice|model|ref|row|rows|line|lines|item|release|build|doi|sku|lot|fig|figure|table|score|price|prices|dated?|years?|since|between|rev|batch|ticket|code"
#: Features told by a pattern: name, where it is looked for, pattern. Java and Python read them alike.
FLAGS = [(f"cue {k}", "before", f"(?i)(?:^|[^A-Za-z])(?:{CUES[k]}){LINK}") for k in KINDS] + [
    ("other", "before", f"(?i)(?:^|[^A-Za-z])(?:{OTHERS}){LINK}|[#$]$|[#$] $"),
    ("unit", "after", r"(?i)^ ?(?:%|\$|(?:kg|km|cm|mm|ml|px|mb|gb|kb|pages|years|items|rows|people|euros?|dollars?|points?|units|copies)(?:[^A-Za-z]|$))"),
    ("date", "found", r"^(?:(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)?[0-9]{2})$"),
    ("years", "found", r"^(?:1[5-9]|20)[0-9]{2} ?[-/ ] ?(?:1[5-9]|20)[0-9]{2}$"),
    ("zero", "found", r"^\(?0"), ("two zeros", "found", r"^\(?00"), ("paren", "found", r"^\("), ("bracket", "found", r"[\[({<]"), ("at sign", "found", "@"), ("dot in words", "found", "(?i)[^a-z](?:dot|punkt|point|punto)[^a-z]"),
    ("known end", "found", r"(?i)[^a-z](?:com|org|net|de|fr|es|edu|gov|io|info|eu|uk|biz|dev|ch|it|nl)$"), ("dotted address", "found", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"),
]
#: Features that count code points of a class in what was found.
CLASSES = {"digits": "0-9", "letters": "A-Za-z", "dots": ".", "dashes": "\\u2010-\\u2015-", "slashes": "/", "spaces": " \\u00a0", "lines": "_", "colons": ":"}
MEASURES = ["length", "groups", "longest group", "first group", "last group", "distinct digits", "checksum", "groups small"]
FEATURES = [f[0] for f in FLAGS] + list(CLASSES) + MEASURES
ROUNDS, DEPTH, PRECISION = 30, 3, 0.97


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return bool(digits) and total % 10 == 0


def plain_features(before: str, found: str, after: str) -> list[float]:
    """As the expressions of the operator give them."""
    where = {"before": before, "found": found, "after": after}
    digits, groups = re.sub("[^0-9]", "", found), re.findall("[0-9]+", found)
    sizes = [len(g) for g in groups] or [0]
    return [
        *(float(bool(re.search(p, where[w]))) for _, w, p in FLAGS), *(float(len(re.findall(f"[{c}]", found))) for c in CLASSES.values()),
        float(len(found)), float(len(groups)), float(max(sizes)), float(sizes[0]), float(sizes[-1]), float(len(set(digits))), float(luhn(digits)), float(all(int(g) <= 255 for g in groups)),
    ]


def fits(kind: str, found: str) -> bool:
    low, high = DIGITS.get(kind, (0, len(found)))
    return low <= len(re.sub("[^0-9]", "", found)) <= high


def candidates(kind: str, text: str) -> list[tuple[int, int, str, str, str]]:
    """What the kind's generators find: start, end, and the text before, in and after, as context up to the generator's next finds."""
    out = []
    for of, pattern in GENERATORS:
        found = list(re.finditer(pattern, text)) if of == kind else []
        for i, m in enumerate(found):
            low, high = found[i - 1].end() if i else 0, found[i + 1].start() if i + 1 < len(found) else len(text)
            if fits(kind, m[0]):
                out.append((m.start(), m.end(), text[max(low, m.start() - BEFORE) : m.start()], m[0], text[m.end() : min(high, m.end() + AFTER)]))
    return out


def made_texts(kind: str, count: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Texts with the spans of personal data of the kind in them; about half have none, but something alike."""
    rng = random.Random(f"{kind} {seed}")
    some = rng.choice
    digits = lambda n: "".join(some("0123456789") for _ in range(n))
    name = lambda: "".join(some("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    words = lambda n: " ".join(some("the of and on that with der die das und le la les que por para con una in we they had new old long time city house water".split()) for _ in range(n))
    end = lambda: some(["com", "org", "net", "de", "fr", "es", "io", "edu", "co.uk"])
    cue = {
        "email": ["email ", "e-mail: ", "contact ", "write to ", "Kontakt: ", "mail me at ", "courriel : ", "correo: ", "reach us at "], "ip": ["host ", "IP: ", "from ", "server at ", "client ", "ping ", "IP address is ", "gateway "],
        "card": ["card ", "Visa: ", "card number is ", "Karte ", "carte : ", "tarjeta ", "credit card no ", "paid by "], "phone": ["call ", "phone: ", "tel. ", "Telefon ", "my number: ", "number is ", "Nr. ", "n\u00famero: ", "fax ", "mobile number ", "call me at ", "whatsapp ", "tel: "],
    }[kind]
    other = ["version ", "ISBN ", "order ", "part ", "pages ", "section ", "serial ", "invoice ", "row ", "ref. ", "# ", "score ", "price $", "since ", "between ", "table ", "batch ", "ticket ", "order number ", "invoice number: ", "part nr ", "serial number is ", "model number "]

    def card(n: int) -> str:
        body = some(["4", "51", "37", "6011"])
        body += digits(n - 1 - len(body))
        return next(body + c for c in "0123456789" if luhn(body + c))

    def grouped(d: str, sizes: list[int], sep: str) -> str:
        out, at = [], 0
        for size in sizes:
            out.append(d[at : at + size])
            at += size
        return sep.join(out)

    def right() -> str:
        if kind == "email" and rng.random() < 0.25:
            line, who, host = some("__-"), some([name(), f"{name()}{some('._')}{name()}"]), [name(), *end().split(".")]
            dots = f"{line}{some(['dot', 'DOT'])}{line}"
            return some([f"{who}{line}{some(['at', 'AT'])}{line}{dots.join(host)}", " ".join("".join([name(), "@", ".".join(host)]))])
        if kind == "email":
            at = some([" [at] ", "[at]", " (at) ", "(at)", " {at} ", " at ", " AT ", " @ ", "[@]", " <at> "])
            dot = some([" [dot] ", "[dot]", " (dot) ", " dot ", " DOT ", ".", ".", " punkt ", " punto ", "(.)"]) if at.strip(" ").lower() != "at" else some([" dot ", " DOT ", " punkt ", " point ", " [dot] "])
            return some([name(), f"{name()}.{name()}", f"{name()}{digits(2)}"]) + at + some([name(), f"{name()}-{name()}"]) + dot.join(["", end().replace(".", dot)])
        if kind == "ip":
            octets = [str(rng.randint(1, 255)) for _ in range(4)]
            six = [f"{rng.getrandbits(16):x}" for _ in range(8)]
            return some([some(["[.]", "(.)", "[dot]", " dot ", " . "]).join(octets)] * 3 + [":".join(six), ":".join(six[:3]) + "::" + ":".join(six[3:5]), f"fe80::{six[0]}:{six[1]}"])
        if kind == "card":
            n = some([16, 16, 15, 13])
            sizes = {16: [4, 4, 4, 4], 15: [4, 6, 5], 13: [4, 3, 3, 3]}[n]
            return grouped(card(n), sizes, some([".", "_", "/", " - ", "  ", " ", "-", "\u2013", "\u00a0"] if n == 16 else [" ", "-", "."]))
        area, sep = f"{rng.randint(200, 989)}", some(["-", ".", " ", "/", "-", ".", " ", "\u2013", "\u00a0", " - "])
        return some([f"({area}) {digits(3)}-{digits(4)}", f"({area}){digits(3)}{sep}{digits(4)}", f"{area}{sep}{digits(3)}{sep}{digits(4)}", f"0{digits(2)} {digits(rng.randint(6, 8))}", f"(0{digits(2)}) {digits(rng.randint(6, 8))}", f"0{digits(3)} / {digits(rng.randint(6, 8))}", f"0{digits(3)}-{digits(7)}",  f"{area}{sep}{digits(3)}{sep}{digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"0{digits(3)}/{digits(6)[:5]}", f"00{some(['44', '49', '33', '34'])} {digits(2)} {digits(4)} {digits(4)}", f"0{digits(1)} {' '.join(digits(2) for _ in range(4))}", f"0{digits(9)}", f"9{digits(2)} {digits(3)} {digits(3)}"])

    def wrong() -> str:
        if kind == "email":
            return some([f"{words(1)} at {name()}.{name()}", f"look at {words(1)} {name()}.{digits(1)}", f"{name()} (at) {digits(1)}.{digits(2)}", f"{words(1)} at {words(1)} point {name()}", f"apples @ {digits(1)}.{digits(2)}", f"{name()} at noon. {words(1)}", f"{name()} [at] {digits(2)}.{digits(2)}", f"sold at the point of sale", f"tickets at {name()}.{some(['html', 'php', 'txt'])}", f"look_at_{name()}", f"{name()}_at_{name()}.{some(['html', 'py', 'txt'])}", f"{name()}-at-{name()}", " ".join(f"a @ {digits(1)} . {digits(1)}".split()), f"{digits(1)} @ {digits(1)} . {digits(2)}"])
        if kind == "ip":
            return some([f"{digits(3)}[.]{rng.randint(256, 999)}[.]{digits(1)}[.]{digits(2)}", f"{rng.randint(1, 12)}:{digits(2)}:{digits(2)}", f"{digits(1)} . {digits(1)} . {digits(1)} . {digits(1)}", f"add::bad", f"{name()[:1]}::{name()[:3]}", f"{rng.randint(256, 999)} dot {digits(2)} dot {digits(1)} dot {digits(1)}", f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{digits(3)}.{digits(3)}", f"::{digits(1)}", f"{digits(2)}::{digits(1)}"])
        if kind == "card":
            bad = card(16)[:-1] + some("0123456789")
            bad = bad if not luhn(bad) else bad[:-1] + str((int(bad[-1]) + 1) % 10)
            return some([bad, grouped(bad, [4, 4, 4, 4], some([".", "_", "/", " ", "-"])), f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"2024-{digits(2)}-{digits(2)} {digits(2)} {digits(2)} {digits(2)}", " ".join(digits(rng.randint(1, 3)) for _ in range(8)), digits(14), digits(17), " ".join(digits(2) for _ in range(8))])
        return some([f"20{digits(2)} {digits(rng.randint(5, 8))}", f"{digits(2)} {digits(7)}", f"{digits(5)} - {digits(5)}", f"{digits(4)}\u2013{digits(4)}", f"1{digits(3)}-20{digits(2)}", f"20{digits(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{digits(2)}", f"19{digits(2)}-20{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(2)}.{digits(2)}", f"{rng.randint(1, 9)}.{digits(3)}.{digits(3)}", digits(rng.randint(7, 12)), f"{digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(1)} - {digits(1)}", f"{rng.randint(1, 5)}/{rng.randint(6, 9)}", ".".join(str(rng.randint(0, 255)) for _ in range(4)), digits(16), grouped(digits(16), [4, 4, 4, 4], " "), f"{digits(3)} {digits(3)} {digits(3)}"])

    out = []
    for _ in range(count):
        good = rng.random() < 0.5
        planted = right() if good else wrong()
        weak = kind == "phone" and not re.match(r"^(?:\(|00)", planted)  # plain groups of digits are a phone number where the text says so
        ahead = words(rng.randint(0, 4)) + " "
        ahead += some(cue) if good and (weak or rng.random() < 0.7) else some(other) if not good and rng.random() < 0.4 else ""
        if not good and not weak and rng.random() < 0.15:
            ahead += some(cue)
        after = some([".", ",", " ", ")", ""]) + (some([" kg", " pages", "%", " items"]) if not good and rng.random() < 0.2 else " " + words(rng.randint(0, 4)))
        out.append((ahead + planted + after, [(len(ahead), len(ahead) + len(planted))] if good else []))
    return out


def table(kind: str, texts: list[tuple[str, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all candidates in the texts."""
    rows = [(plain_features(*c[2:]), float((c[0], c[1]) in spans)) for text, spans in texts for c in candidates(kind, text)]
    return np.array([x for x, _ in rows], np.float32), np.array([y for _, y in rows])


@dataclass
class Model:
    trees: Trees
    slope: float
    offset: float
    threshold: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x).astype(float) + self.offset, -40, 40)))


@functools.cache
def fit(kind: str, count: int = 900, precision: float = PRECISION) -> Model:
    """Trees from `count` texts, calibrated on half as many others; the threshold is the least probability from which at least `precision` of these are right."""
    trees = boost(*table(kind, made_texts(kind, count, 1)), depth=DEPTH, rounds=ROUNDS)
    x, y = table(kind, made_texts(kind, count // 2, 2))
    slope, offset = platt(trees.margin(x).astype(float), y)
    model = Model(trees, slope, offset, 1.0)
    p = model.probability(x)
    order = np.argsort(-p, kind="stable")
    share = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.flatnonzero((share >= precision) & np.append(np.diff(p[order]) < 0, True))
    # rounded down, so that a sum in another order makes no difference
    model.threshold = float(np.floor(max(0.5, p[order][last[-1]]) * 1e4) / 1e4) if len(last) else 1.0
    return model
