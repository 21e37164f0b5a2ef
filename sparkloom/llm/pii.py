"""Operator 10: personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns find what is written plainly; what they find stays. The field adds what they miss:
phone numbers without a plus sign, cards with other separators, addresses written with [at] or [.],
and secrets: keys, tokens and passwords that stand behind a word for them.
It scores candidate segments as wholes - shape of the digit groups, checksum, separators, characters
around, a cue word before - and chooses boundaries and types together by dynamic programming over
segments of bounded length. Its weights are learned here, by conditional likelihood, from sentences
that a seeded generator writes and labels. Texts are worked on one by one, so nothing is shuffled.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: An entity has at most so many digit groups and digits; a separator at most so many characters.
MOST_GROUPS, MOST_DIGITS, MOST_GAP = 6, 19, 3
#: A secret has so many characters.
LEAST_SECRET, MOST_SECRET = 12, 200
#: Sentences of the training set, passes over it, and its seed.
SENTENCES, PASSES, SEED = 4000, 6, 10
#: An added segment must be likelier than none by so much, in nats: clean texts are left alone.
MARGIN = 2.0

_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    return len(short := digits.lstrip("0")) < 4 and int(short or "0") <= 255


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans by start, then kind. Each pattern is applied in time linear in the text.

    An e-mail address can only begin where its run of allowed characters does (or where the match
    before ended), so the search goes from one @ to the next instead of from every character.
    """
    found: list[tuple[int, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        tail = _DOMAIN.match(text, at + 1)
        if tail:
            start = at
            while start > end and _LOCAL_END.match(text, start - 1):
                start -= 1
            if start < at:
                end = tail.end()
                found.append((start, 0, end))
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


# ---------------------------------------------------------------- candidate segments and their features

_SEP = re.compile(r"[   ]?(?:[-./–·_]|\[\.\]|\(\.\)|\) ?| \()?[   ]?")
_AT = re.compile(r"@|[\[({] ?[aA][tT] ?[\])}]| at (?=[A-Za-z0-9-]{1,63} dot )")
_LEFT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?\Z")
_RIGHT = re.compile(r" ?[A-Za-z0-9-]{1,63}(?:(?: ?\. ?| dot | ?[\[({] ?(?:dot|\.) ?[\])}] ?)[A-Za-z0-9-]{1,63}){1,6}")
_WORDS = re.compile(r"[^\W\d_]+")
_OPAQUE = re.compile(r"[A-Za-z0-9_+/=.!@#$%^&*~-]{12,}")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_ASSIGN = re.compile(r"(?:[:=]|=>|\bis)\s?[\"'`]?\Z|[\"'`]\Z|\s\Z")
# Words that announce a kind.
_CUES = {
    "phone": "tel phone telephone call mobile cell fax dial ring whatsapp téléphone telefon teléfono handy móvil",
    "card": "card visa mastercard amex credit debit carte karte tarjeta",
    "ip": "ip host server gateway ping serveur servidor",
    "email": "mail email contact write courriel correo",
    "secret": "token secret password passwd pwd key apikey passphrase bearer credential credentials auth authorization",
    "other": "order id isbn version date invoice serial ref no number code year build commit sha md5 checksum hash revision etag uuid digest",
}
_CUE = {w: kind for kind, words in _CUES.items() for w in words.split()}


def _kind_of(c: str) -> str:
    if not c or c.isspace():
        return "space"
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "quote" if c in "\"'" else "stop" if c in ".,;:!?" else c


def _cue(text: str, at: int) -> str:
    words = _WORDS.findall(text[max(0, at - 24) : at].lower())
    for w in reversed(words[-3:]):
        if w in _CUE:
            return _CUE[w]
    return "none"


def _number_features(text: str, a: int, b: int, groups: list[str], gaps: list[str], left: bool, right: bool) -> list[str]:
    digits, before, after = "".join(groups), text[a - 1 : a], text[b : b + 1]
    opens = text[a] if text[a] in "+(" else "0" if text[a] == "0" else "-"
    seps = "".join(sorted({g.strip() or " " for g in gaps}))
    return [
        "bias", f"n={len(digits)}", f"shape={','.join(str(len(g)) for g in groups)}", f"groups={len(groups)}", f"opens={opens}", f"seps={seps}",
        f"luhn={len(digits) >= 12 and luhn(digits)}", f"quad={len(groups) == 4 and all(map(_octet, groups)) and '.' in seps}", f"before={_kind_of(before)}", f"after={_kind_of(after)}",
        f"cue={_cue(text, a)}", f"whole={left}{right}", f"opens={opens}&n={len(digits)}", f"cue={_cue(text, a)}&groups={min(len(groups), 4)}",
    ]


def _secret_features(text: str, a: int, b: int) -> list[str]:
    body = text[a:b]
    sets = "hex" if _HEX.fullmatch(body) else "".join(n for n, on in (("a", any("a" <= c <= "z" for c in body)), ("A", any("A" <= c <= "Z" for c in body)), ("0", any(c.isdigit() for c in body)), ("_", not body.isalnum())) if on)
    turns = sum(x.isdigit() != y.isdigit() for x, y in zip(body, body[1:], strict=False))
    before = _ASSIGN.search(text, max(0, a - 4), a)
    sign, cue = before[0].strip() if before else "-", _cue(text, a)
    return ["bias", f"n={len(body).bit_length()}", f"sets={sets}", f"turns={min(turns, 6)}", f"sign={sign}", f"cue={cue}", f"cue={cue}&sign={bool(sign)}", f"cue={cue}&sets={sets}", f"cue={cue}&digits={turns > 0}", f"quotes={text[a - 1 : a] in (chr(34), chr(39), chr(96))}{text[b : b + 1] in (chr(34), chr(39), chr(96))}"]


def candidates(text: str, taken: list[Span]) -> list[tuple[int, int, list[tuple[str, list[str]]]]]:
    """(start, end, [(kind, features)]) of every segment that may be an entity and meets no span of `taken`; no more per digit group than MOST_GROUPS."""
    out: list[tuple[int, int, list[tuple[str, list[str]]]]] = []
    firsts, lasts = [], []
    for a, b in sorted((a, b) for _, a, b in taken):
        if lasts and a < lasts[-1]:
            lasts[-1] = max(lasts[-1], b)
        else:
            firsts.append(a)
            lasts.append(b)

    def free(a: int, b: int) -> bool:
        k = bisect_left(firsts, b)
        return not k or lasts[k - 1] <= a

    runs = [m.span() for m in _DIGITS.finditer(text)]
    for i, (a0, _) in enumerate(runs):
        groups, gaps, n = [], [], 0
        a = a0 - 1 if a0 and text[a0 - 1] in "+(" else a0
        joined = i > 0 and runs[i - 1][1] + MOST_GAP + 1 >= a0 and bool(_SEP.fullmatch(text, runs[i - 1][1], a))
        for j in range(i, min(len(runs), i + MOST_GROUPS)):
            x, y = runs[j]
            if j > i:
                gap = text[runs[j - 1][1] : x]
                if len(gap) > MOST_GAP or not gap or not _SEP.fullmatch(gap):
                    break
                gaps.append(gap)
            groups.append(text[x:y])
            n += y - x
            if n > MOST_DIGITS:
                break
            if n < 7 and not (len(groups) == 4 and n >= 4):
                continue
            follows = j + 1 < len(runs) and len(gap := text[y : runs[j + 1][0]]) <= MOST_GAP and bool(gap) and bool(_SEP.fullmatch(gap))
            quad = len(groups) == 4 and n <= 12 and all("." in g for g in gaps)
            kinds = [k for k, ok in (("ip", quad), ("card", 12 <= n <= 19), ("phone", 7 <= n <= 15)) if ok]
            if kinds and free(a, y):
                made = _number_features(text, a, y, groups, gaps, not joined, not follows)
                out.append((a, y, [(k, made) for k in kinds]))
    for m in _AT.finditer(text):
        low = max(0, m.start() - 65)
        local, domain = _LEFT.search(text[low : m.start()]), _RIGHT.match(text, m.end())
        if not local or not domain:
            continue
        a, b = low + local.start(), domain.end()
        if free(a, b):
            last = re.split("[^A-Za-z0-9]+", domain[0])[-1]
            sign = m[0].strip().lower()
            made = ["bias", f"at={sign}", f"dot={'dot' in domain[0].lower()}", f"bracket={any(c in domain[0] for c in '[({')}", f"tld={min(len(last), 5)}", f"letters={last.isalpha()}", f"cue={_cue(text, a)}", f"space={local[0].endswith(' ')}", f"upper={last.isupper() or last.istitle()}", f"at={sign}&dot={'dot' in domain[0].lower()}", f"gap={'. ' in domain[0] or ' .' in domain[0]}", f"at={sign}&gap={'. ' in domain[0] or ' .' in domain[0]}"]
            out.append((a, b, [("email", made)]))
    for m in _OPAQUE.finditer(text):
        a, b = m.start(), m.end()
        while b > a and text[b - 1] in ".!":
            b -= 1
        # a name and its value in one run: KEY=value
        eq = text.find("=", a, b - LEAST_SECRET)
        if eq > a and not text[a:eq].isdigit():
            a = eq + 1
        if LEAST_SECRET <= b - a <= MOST_SECRET and any(c.isdigit() for c in text[a:b]) and any(c.isalpha() for c in text[a:b]) and free(a, b):
            out.append((a, b, [("secret", _secret_features(text, a, b))]))
    return sorted(out, key=lambda c: (c[0], c[1]))


# ---------------------------------------------------------------- the field

Weights = dict[str, float]
_NONE = "none"


def _islands(found: list) -> list[list]:
    """Candidates in groups that neither overlap nor touch."""
    out: list[list] = []
    end = -1
    for c in found:
        if c[0] > end:
            out.append([])
        out[-1].append(c)
        end = max(end, c[1])
    return out


def _scored(island: list, w: Weights) -> list[tuple[int, int, str, float, list[str]]]:
    return [(a, b, k, sum(w.get(f"{k}|{f}", 0.0) for f in feats), feats) for a, b, kinds in island for k, feats in kinds]


def decode(island: list, w: Weights, margin: float = MARGIN) -> list[Span]:
    """The best segmentation of an island: segments of a kind, and between them stretches of none, with a weight for each succession of labels."""
    segments = _scored(island, w)
    points = sorted({p for s in segments for p in s[:2]})
    where = {p: i for i, p in enumerate(points)}
    ending: dict[int, list] = defaultdict(list)
    for s in segments:
        ending[where[s[1]]].append(s)
    best: list[dict[str, tuple[float, tuple | None]]] = [{_NONE: (0.0, None)}]
    for i in range(1, len(points)):
        here = {_NONE: (max(x[0] for x in best[i - 1].values()), None)}
        label = max(best[i - 1], key=lambda y: best[i - 1][y][0])
        here[_NONE] = (best[i - 1][label][0], (i - 1, label, None))
        for a, b, k, score, _ in ending[i]:
            j = where[a]
            value, label = max((x[0] + w.get(f"{y}>{k}", 0.0), y) for y, x in best[j].items())
            if k not in here or value + score - margin > here[k][0]:
                here[k] = (value + score - margin, (j, label, (k, a, b)))
        best.append(here)
    out: list[Span] = []
    i, label = len(points) - 1, max(best[-1], key=lambda y: best[-1][y][0])
    while i > 0:
        j, before, span = best[i][label][1]
        if span:
            out.append(span)
        i, label = j, before
    return out[::-1]


def _add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def likelihood_step(island: list, gold: set[Span], w: Weights, gradient: dict[str, float]) -> float:
    """Adds the gradient of the log-likelihood of `gold` and returns that likelihood, by the forward and backward sums over all segmentations."""
    segments = _scored(island, w)
    points = sorted({p for s in segments for p in s[:2]})
    where, last, labels = {p: i for i, p in enumerate(points)}, len(points) - 1, (_NONE, *KINDS)
    forward = [dict.fromkeys(labels, -math.inf) for _ in points]
    backward = [dict.fromkeys(labels, -math.inf) for _ in points]
    forward[0][_NONE], backward[last] = 0.0, dict.fromkeys(labels, 0.0)
    ending, starting = defaultdict(list), defaultdict(list)
    for s in segments:
        ending[where[s[1]]].append(s)
        starting[where[s[0]]].append(s)
    for i in range(1, last + 1):
        for v in forward[i - 1].values():
            forward[i][_NONE] = _add(forward[i][_NONE], v)
        for a, _, k, score, _ in ending[i]:
            for y, v in forward[where[a]].items():
                forward[i][k] = _add(forward[i][k], v + score + w.get(f"{y}>{k}", 0.0))
    for i in range(last - 1, -1, -1):
        for y in labels:
            total = backward[i + 1][_NONE]
            for _, b, k, score, _ in starting[i]:
                total = _add(total, score + w.get(f"{y}>{k}", 0.0) + backward[where[b]][k])
            backward[i][y] = total
    z = backward[0][_NONE]
    value, label, at = -z, _NONE, None
    for a, b, k, score, feats in segments:
        right = (k, a, b) in gold
        for y in labels:
            p = math.exp(min(0.0, forward[where[a]][y] + score + w.get(f"{y}>{k}", 0.0) + backward[where[b]][k] - z))
            if p:
                gradient[f"{y}>{k}"] -= p
                for f in feats:
                    gradient[f"{k}|{f}"] -= p
        if right:
            label = label if at == a else _NONE
            value += score + w.get(f"{label}>{k}", 0.0)
            gradient[f"{label}>{k}"] += 1
            for f in feats:
                gradient[f"{k}|{f}"] += 1
            label, at = k, b
    return value


def _sentence(rng: random.Random) -> tuple[str, list[Span]]:
    """A sentence of invented words with one or two marked entities, or with numbers that are none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioulrstndmp") for _ in range(rng.randint(2, 9)))
    pick = rng.choice

    def card() -> str:
        while True:
            n = pick((15, 16, 16, 16))
            x = pick("3456") + d(n - 1)
            if luhn(x):
                cut = (4, 6, 5) if n == 15 else (4, 4, 4, 4)
                sep, at, parts = "." if rng.random() < 0.6 else pick(("/", "_", " ", "  ")), 0, []
                for c in cut:
                    parts.append(x[at : at + c])
                    at += c
                return sep.join(parts)

    def phone() -> str:
        return pick((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"00{d(2)} {d(2)} {d(7)}", f"0{d(3)}/{d(7)}", f"0{d(10)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(rng.randint(6, 8))}", f"0{d(3)} {d(rng.randint(5, 7))}"))

    def ip() -> str:
        return pick(("[.]", "(.)", " . ")).join(str(rng.randint(0, 255)) for _ in range(4))

    def email() -> str:
        name, host, top = word() + pick(("", "." + word(), d(2))), word(), pick(("com", "org", "net", "de", "fr", "es", "io"))
        return pick((f"{name} [at] {host} [dot] {top}", f"{name}(at){host}(dot){top}", f"{name} at {host} dot {top}", f"{name} @ {host}.{top}", f"{name}[at]{host}.{top}"))

    def opaque() -> str:
        letters = pick(("0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNP23456789!#%&*"))
        n = pick((12, 14, 16, 20, 24, 32, 32, 40, 40, 44, 64, 88))
        while True:
            made = "".join(pick(letters) for _ in range(n))
            if any(c.isdigit() for c in made) and any(c.isalpha() for c in made) and made[-1] not in "!":
                return pick(("", "", "", "", "sk_live_", "ghp_", "AKIA")) + made

    def none() -> str:
        if rng.random() < 0.15:
            # long names that are no secrets: digests without a word for one, links, files
            return pick((opaque(), f"{word()}/{word()}/{d(4)}/{word()}-{word()}.html", f"{word()}_{d(8)}_{word()}.txt", "-".join("".join(pick("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12))))
        return pick((f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{d(4)} {d(2)}:{d(2)}", d(rng.randint(5, 30)), f"{d(1)}.{d(1)}.{d(2)}.{d(4)}", " ".join(d(rng.randint(1, 5)) for _ in range(rng.randint(2, 9))), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(3)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"{d(3)}.{d(3)}.{d(3)}", f"{word()} @ {word()}", f"{d(3)},{d(3)},{d(3)}.{d(2)}", f"{d(1)}.{d(6)} {d(1)}.{d(6)}", f"{d(8)}-{d(6)}", f"{d(4)}-{d(4)}", f"0.{d(9)}", f"at {word()} {word()}", f"{d(13)}", f"{d(2)}{pick('abcdef')}{d(7)}{pick('abcdef')}{d(9)}", f"{d(4)}.{d(4)}.{d(4)}.{d(4)}"))

    parts, spans, at = [], [], 0

    def put(s: str, kind: str | None = None) -> None:
        nonlocal at
        if kind:
            spans.append((kind, at, at + len(s)))
        parts.append(s)
        at += len(s)

    for _ in range(rng.randint(1, 4)):
        put(word() + " ")
    for _ in range(rng.randint(1, 2)):
        make, kind = pick(((card, "card"), (phone, "phone"), (ip, "ip"), (email, "email"), (opaque, "secret"), (none, None), (none, None), (none, None), (none, None)))
        cued = rng.random()
        if kind == "secret":
            put(pick(("", "api_", "access ", "my ")) + pick(_CUES["secret"].split()) + (sign := pick((" = \"", "=\"", ": ", " is ", "=", "='", ": \"", " = ", " "))))
            put(make(), kind)
            put((sign[-1] if sign[-1] in "\"'" else "") + pick((" ", ". ", ", ", "; ")) + word() + " ")
            continue
        if kind == "phone" and cued < 0.5 or cued < 0.2 and kind:
            put(pick(_CUES[kind].split()) + pick((" ", ": ", ". ")))
        elif kind is None and cued < 0.4:
            put(pick(_CUES["other"].split()) + pick((" ", ": ")))
        if kind == "phone" and rng.random() < 0.25:
            # plain, but run together with what follows, so that the base pattern sees too many digits
            put(f"+{d(rng.randint(1, 2))} " + pick((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}")), kind)
            put(" " + pick((".".join(str(rng.randint(10, 255)) for _ in range(4)), d(6))))
        else:
            put(make(), kind)
        put(pick((" ", ". ", ", ", "; ")) + word() + " ")
    for _ in range(rng.randint(0, 3)):
        put(word() + " ")
    text = "".join(parts)
    # a long digit run of no kind may be a card by chance, which the base patterns would have found
    return text, [s for s in spans if not any(a < s[2] and s[1] < b for _, a, b in base_spans(text))]


@cache
def weights(sentences: int = SENTENCES, passes: int = PASSES, seed: int = SEED) -> Weights:
    """Weights by stochastic gradient with per-feature steps; the same seed gives the same weights."""
    rng = random.Random(seed)
    islands = []
    for _ in range(sentences):
        text, gold = _sentence(rng)
        islands += [(x, set(gold)) for x in _islands(candidates(text, base_spans(text)))]
    w: Weights = {}
    seen: dict[str, float] = defaultdict(float)
    for _ in range(passes):
        rng.shuffle(islands)
        for island, gold in islands:
            gradient: dict[str, float] = defaultdict(float)
            likelihood_step(island, gold, w, gradient)
            for f, g in gradient.items():
                g -= 1e-3 * w.get(f, 0.0)
                seen[f] += g * g
                w[f] = w.get(f, 0.0) + 0.5 * g / math.sqrt(seen[f] + 1e-9)
    return w


def spans_of(text: str, w: Weights) -> tuple[list[Span], list[Span]]:
    """The base spans and all spans, each by start, then kind, then end. Added spans meet neither base spans nor each other."""
    base = base_spans(text)
    more = [s for island in _islands(candidates(text, base)) for s in decode(island, w)]
    return base, sorted([*base, *more], key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---------------------------------------------------------------- Spark


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and `spans`, an array of (kind, start, end, base) in code points with exclusive ends, one row per row of df.

    A null text counts as empty and has no spans; repeated rows get equal answers; an empty table
    gives an empty one; other columns are not read. Null doc_ids stay null. Texts of any length are
    read whole, in time linear in their length.
    """
    w = weights()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for t in part.column(1).to_pylist():
                    base, every = spans_of(t or "", w)
                    known = set(base)
                    rows.append([{"kind": s[0], "start": s[1], "end": s[2], "base": s in known} for s in every])
                kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(kind))], names=["doc_id", "spans"])

    plain = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every span of `text` replaced by its kind in angle brackets; overlapping spans become one, named by the first. Null texts stay null."""
    from pyspark.sql.functions import pandas_udf

    w = weights()

    def masked(t: str) -> str:
        out, at = [], 0
        for k, a, b in spans_of(t, w)[1]:
            if a >= at:
                out += [t[at:a], f"<{k}>"]
            at = max(at, b)
        return "".join(out) + t[at:]

    @pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if t is None else masked(t))

    return df.withColumn(text, run(F.col(f"`{text}`")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of every document's base spans, all its spans, how many these are and whether there is any."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = [F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("has_private")]
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), *every)
