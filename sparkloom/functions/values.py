"""Functions of dates, addresses, numbers, logs, HTML and language; Columns where built-in expressions suffice."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import STOPWORDS, col, java

# ---------------------------------------------------------------- dates

# Python's format letters in Java's.
_FORMATS = {"d": "dd", "m": "MM", "y": "yy", "Y": "yyyy", "H": "HH", "M": "mm", "S": "ss", "I": "hh", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "f": "SSSSSS", "z": "xx", "%": "'%'"}


def java_format(pattern: str) -> str:
    """A strftime pattern in Java's dialect; letters outside directives are quoted."""
    return re.sub(r"%(.)|([A-Za-z]+)", lambda m: _FORMATS[m[1]] if m[1] else f"'{m[2]}'", pattern)


def dateformat(date, source: str = "%d-%m-%y", target: str = "%Y-%m-%d") -> Column:
    """A date rewritten; NULL if it does not parse."""
    return F.date_format(F.try_to_timestamp(col(date), F.lit(java_format(source))), java_format(target))


def cleantimezone(date) -> Column:
    """ISO text without its zone and with a space for the T."""
    spaced = F.replace(col(date), F.lit("T"), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(spaced, r"\+.*$", ""), r"^(.{14,})-[^-]*$", "$1")


def _age(date, now) -> Column:
    return F.datediff(col(now), col(date))


def activityindex(date, now) -> Column:
    """5 for less than 30 days before `now`, 4 for 90, 3 for 180, 2 for 360, 1 for 720, else 0."""
    out = F.when(_age(date, now) < 30, 5)
    for days, value in ((90, 4), (180, 3), (360, 2), (720, 1)):
        out = out.when(_age(date, now) < days, value)
    return out.otherwise(0)


def sectohuman(seconds) -> Column:
    """`d day[s] h hour[s] m min s sec`; zero parts are left out, and a blank stays after the last of the larger units."""
    s = col(seconds).cast("long")
    d, h, m, r = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    named = lambda n, one: F.when(n > 0, F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {one} ")).otherwise(f" {one}s "))).otherwise("")
    return F.concat(named(d, "day"), named(h, "hour"), F.when(m > 0, F.concat(m.cast("string"), F.lit(" min "))).otherwise(""), F.when(r > 0, F.concat(r.cast("string"), F.lit(" sec"))).otherwise(""))


def datestrf2isoweek(text) -> Column:
    """yyyyWww with week 00 as the last week (53) of the year before."""
    t = col(text)
    year = F.substring(t, 1, 4).try_cast("int")
    return F.when(F.right(t, F.lit(2)) == "00", F.concat((year - 1).cast("string"), F.lit("W53"))).otherwise(t)


# Date forms that date2iso reads, after the zone has been taken off.
_DATE_FORMS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyyMMdd'T'HHmmss", "yyyyMMdd", "yyyy-MM", "yyyy", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd/MMM/yyyy:HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "d MMMM yyyy", "MMM d HH:mm:ss yyyy", "MMM d, yyyy", "MMMM d, yyyy")


def date2iso(date) -> Column:
    """ISO text, with the zone written in the date or +00:00, of a date in one of the usual forms; NULL for others. yyyyWww is the first of January and ww - 1 weeks."""
    text = F.regexp_replace(F.trim(col(date)), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +", "")
    timed = text.rlike(r"\d:?\d\d(:?\d\d(\.\d+)?)? ?(Z|GMT|UTC|[+-]\d\d:?\d\d)$")
    zone = F.regexp_extract(text, r"([+-]\d\d):?(\d\d)$", 0)
    offset = F.when(timed & (zone != ""), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.right(zone, F.lit(2)))).otherwise("+00:00")
    bare = F.when(timed, F.regexp_replace(text, r" ?(Z|GMT|UTC|[+-]\d\d:?\d\d)$", "")).otherwise(text)
    week = F.regexp_extract(text, r"^(\d{4})-?W(\d\d)$", 1), F.regexp_extract(text, r"^(\d{4})-?W(\d\d)$", 2)
    first = F.date_add(F.make_date(week[0].try_cast("int"), F.lit(1), F.lit(1)), (week[1].try_cast("int") - 1) * 7).cast("timestamp_ntz")
    parsed = F.coalesce(first, *[F.call_function("try_to_timestamp", bare, F.lit(f)).cast("timestamp_ntz") for f in _DATE_FORMS])
    return F.concat(F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def tzconverter(ts, offset: str) -> Column:
    """A UTC time in the zone `offset` (+HH:MM, +HHMM or +HH), with the offset after it."""
    sign, hours, minutes = re.fullmatch(r"([+-])(\d\d):?(\d\d)?", offset).groups()
    total = (int(hours) * 60 + int(minutes or 0)) * (-1 if sign == "-" else 1)
    moved = F.try_to_timestamp(F.replace(col(ts), F.lit("T"), F.lit(" "))) + F.make_interval(mins=F.lit(total))
    return F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))


# ---------------------------------------------------------------- language


def stem_word(w: str) -> str:
    """The stem of an English word by the published suffix-stripping algorithm of 1980."""
    w = w.lower()
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w

    def kinds(s: str) -> str:
        out = ""
        for i, c in enumerate(s):
            out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
        return out

    def measure(s: str) -> int:
        return len(re.findall("v+c+", kinds(s)))

    def double(s: str) -> bool:
        return len(s) > 1 and s[-1] == s[-2] and kinds(s)[-1] == "c"

    def closed(s: str) -> bool:
        return kinds(s)[-3:] == "cvc" and s[-1] not in "wxy"

    def swap(s: str, rules: str, least: int) -> str:
        for suffix, other in sorted((r.split(">") for r in rules.split()), key=lambda r: -len(r[0])):
            if s.endswith(suffix):
                return s[: -len(suffix)] + other if measure(s[: -len(suffix)]) >= least else s
        return s

    w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) else w
    elif any(w.endswith(x) and "v" in kinds(w[: -len(x)]) for x in ("ed", "ing")):
        w = w[: -len("ed" if w.endswith("ed") else "ing")]
        w += "e" if w.endswith(("at", "bl", "iz")) or not (double(w) and w[-1] not in "lsz") and measure(w) == 1 and closed(w) else ""
        w = w[:-1] if double(w) and w[-1] not in "lsz" else w
    if w.endswith("y") and "v" in kinds(w[:-1]):
        w = w[:-1] + "i"
    # The suffix rules of the published algorithm.
    w = swap(w, "ational>ate tional>tion enci>ence anci>ance izer>ize abli>able alli>al entli>ent eli>e ousli>ous ization>ize ation>ate ator>ate alism>al iveness>ive fulness>ful ousness>ous aliti>al iviti>ive biliti>ble", 1)
    w = swap(w, "icate>ic ative> alize>al iciti>ic ical>ic ful> ness>", 1)
    for suffix in sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if measure(base) > 1 and (suffix != "ion" or base[-1:] in ("s", "t")):
                w = base
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not closed(w[:-1])):
        w = w[:-1]
    return w[:-1] if measure(w) > 1 and double(w) and w.endswith("l") else w


def stem(*texts) -> Column:
    """Every term stemmed and in lower case."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: None if t is None else " ".join(stem_word(w) for w in t.split(" ")))

    return run(F.concat_ws(" ", *map(col, texts)))


def profile(text: str, size: int = 400) -> list[str]:
    """The commonest runs of one to four letters of a text, words padded by blanks."""
    from collections import Counter

    counts: Counter = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        w = f" {w} "
        for n in range(1, 5):
            counts.update(w[i : i + n] for i in range(len(w) - n + 1))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]


def build_profiles(samples: dict[str, str]) -> dict[str, dict[str, int]]:
    """Language -> rank of its n-grams, from a sample text of each."""
    return {lang: {g: i for i, g in enumerate(profile(text))} for lang, text in samples.items()}


def stopword_profiles() -> dict[str, dict[str, int]]:
    """Profiles from the function words of the four languages that the stop list covers, for want of samples."""
    words = {"english": "the and that with this they have which were what when who will you", "french": "les des dans pour avec ces elle mais nous vous sont votre leur qui", "german": "der die das und nicht sich eine sind auch nach über wie dem ist", "spanish": "los las para como pero cuando ellos también sobre entre porque hasta"}
    return build_profiles({k: v + " " + " ".join(w for w in STOPWORDS if w in v) for k, v in words.items()})


def detectlang(*texts, profiles: dict[str, dict[str, int]] | None = None) -> Column:
    """The language whose n-gram ranks are nearest; an empty text gives NULL. Profiles travel with the function and are bounded by 400 n-grams a language."""
    known = profiles or stopword_profiles()

    def one(t):
        grams = profile(t or "")
        if not grams:
            return None
        return min(known, key=lambda lang: (sum(abs(i - known[lang].get(g, 400 + i)) for i, g in enumerate(grams)), lang))

    @F.pandas_udf("string")
    def run(s):
        return s.map(one)

    return run(F.concat_ws(" ", *map(col, texts)))


def stem_en(*texts, profiles: dict[str, dict[str, int]] | None = None) -> Column:
    """Stemmed where the language is English."""
    t = F.concat_ws(" ", *map(col, texts))
    return F.when(detectlang(t, profiles=profiles) == "english", stem(t)).otherwise(t)


# ---------------------------------------------------------------- HTML and addresses

# What tags become, by name.
_NEWLINE = "br|/p|/div|/head|/table|/tr|ul|/ul|/title|/tfoot|/thead|/span|/ol|/h1|/h2|/h3|/h4|/h5|/h6|/caption"
_SPACE = r"/\w+|wbr|p|div|head|table|tr|title|thead|tfoot|source|span|q|pre|ol|link|i|h1|h2|h3|h4|h5|h6|em|code|caption|a|figure|figcaption"
_TYPES = {"pdf": "application/pdf", "html": "text/html", "htm": "text/html", "txt": "text/plain", "csv": "text/csv", "xml": "text/xml", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "zip": "application/zip", "js": "text/javascript", "css": "text/css", "json": "application/json", "mp3": "audio/mpeg", "mp4": "video/mp4", "doc": "application/msword"}


def htmlstriptags(html, default: str = "") -> Column:
    """Tags become a line end, a space or an underscore by their name, others `default`; NULL gives the empty text."""
    t = F.coalesce(col(html), F.lit(""))
    for names, made in ((_NEWLINE, "\n"), (_SPACE, " "), ("sup|sub", "_")):
        t = F.regexp_replace(t, rf"(?Ui)<(?:[^>]*\s)?(?:{names})(?:\s[^>]*)?>", made)
    return F.regexp_replace(t, "<[^>]*>", default.replace("\\", "\\\\").replace("$", "\\$"))


def htmldecode(text) -> Column:
    """Numeric and named entities that a semicolon ends."""
    import html

    entity = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|\w+);")

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda t: None if t is None else entity.sub(lambda m: html.unescape(m[0]), t))

    return run(col(text))


def htmlencode(text) -> Column:
    t = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def htmladdbreaks(text) -> Column:
    """<wbr> after . / and - before a letter."""
    return F.regexp_replace(col(text), r"([./-])([^./\-\d\s])", "$1<wbr>$2")


def htmllink(href, text=None) -> Column:
    full = F.when(F.contains(col(href), F.lit("://")), col(href)).otherwise(F.concat(F.lit("http://"), col(href)))
    return F.concat(F.lit('<a href="'), full, F.lit('">'), col(text) if text is not None else col(href), F.lit("</a>"))


def urldecode(text) -> Column:
    return F.try_url_decode(col(text))


def urlencode(text) -> Column:
    return F.url_encode(col(text))


def _url(url) -> dict[str, Column]:
    u = col(url)
    part = lambda n: F.regexp_extract(u, r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#;]*)(?:;([^?#]*))?(?:\?([^#]*))?(?:#(.*))?$", n)
    return {"scheme": F.lower(part(1)), "netloc": part(2), "path": part(3), "params": part(4), "query": part(5), "fragment": part(6)}


def urlsplit(url) -> Column:
    """A struct: scheme, netloc, path (ends with a slash), filename, type, subtype, params, query, fragment. The type is the MIME type by extension, else the extension."""
    p = _url(url)
    folder = F.regexp_extract(p["path"], "^(.*/)?([^/]*)$", 1)
    name = F.regexp_extract(p["path"], "^(.*/)?([^/]*)$", 2)
    extension = fileextension(name)
    types = F.create_map(*[F.lit(x) for k, v in _TYPES.items() for x in (f".{k}", v)])
    # a parameter after the name hides its type
    mime = F.when((p["params"] == "") & (p["query"] == ""), types[extension])
    return F.struct(p["scheme"].alias("scheme"), p["netloc"].alias("netloc"), folder.alias("path"), name.alias("filename"), F.coalesce(F.split_part(mime, F.lit("/"), F.lit(1)), F.substring(extension, F.lit(2), F.length(extension))).alias("type"), F.coalesce(F.split_part(mime, F.lit("/"), F.lit(2)), F.lit("")).alias("subtype"), p["params"].alias("params"), p["query"].alias("query"), p["fragment"].alias("fragment"))


def urllocation(url) -> Column:
    p = _url(url)
    return F.concat(p["scheme"], F.lit("://"), p["netloc"], p["path"])


def urlquery2jdict(url) -> Column:
    """The query's parameters as JSON; repeated keys become lists, blank values stay."""
    import json
    from urllib.parse import parse_qs, urlsplit as cut

    def one(t):
        if t is None:
            return None
        found = parse_qs(cut(t).query if "?" in t else t, keep_blank_values=True)
        return json.dumps({k: v[0] if len(v) == 1 else v for k, v in found.items()}, separators=(",", ":"), ensure_ascii=False)

    @F.pandas_udf("string")
    def run(s):
        return s.map(one)

    return run(col(url))


def fileextension(path) -> Column:
    """The extension in lower case, with its dot; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(col(path), r"[^/.][^/]*?(\.[^./]*)$", 1))


# ---------------------------------------------------------------- numbers, addresses, logs


def ifthenelse(condition, then, otherwise=None) -> Column:
    """`then` where the condition is neither NULL, 0 nor empty."""
    c = col(condition).cast("string")
    return F.when(c.isNotNull() & ~c.isin("", "0", "0.0", "false"), col(then)).otherwise(col(otherwise) if otherwise is not None else F.lit(None))


def failif(condition, message: str = "failif") -> Column:
    """Raises where the condition holds, else passes it on."""
    return F.when(col(condition), F.raise_error(F.lit(message)).cast("boolean")).otherwise(col(condition))


def randomrange(start: int, end: int, step: int = 1, seed: int | None = None) -> Column:
    return (F.floor(F.rand(seed) * ((end - start + step - 1) // step)) * step + start).cast("long")


def gaussdistribution(mean: float, sigma: float, seed: int | None = None) -> Column:
    return F.randn(seed) * sigma + mean


def sqroot(x) -> Column:
    """NULL for what has none."""
    return F.when(col(x).try_cast("double") >= 0, F.sqrt(col(x).try_cast("double")))


def safediv(default, a, b, integers: bool = True) -> Column:
    """a / b, rounded down for integers; `default` where b is 0."""
    whole = F.floor(F.try_divide(col(a), col(b))) if integers else F.try_divide(col(a), col(b))
    return F.when(col(b) == 0, col(default)).otherwise(whole)


def farith(expression) -> Column:
    """A prefix expression over exact fractions (`+ 1/3 * 2 5`); an integer, else [numerator, denominator]."""
    from fractions import Fraction
    from operator import add, mul, sub, truediv

    operators = {"+": add, "-": sub, "*": mul, "/": truediv}

    def one(text):
        if text is None:
            return None
        stack: list[Fraction] = []
        try:
            for token in reversed(text.split()):
                stack.append(operators[token](stack.pop(), stack.pop()) if token in operators else Fraction(token))
            (value,) = stack
        except (ValueError, IndexError, ZeroDivisionError):
            return None
        return str(value.numerator) if value.denominator == 1 else f"[{value.numerator},{value.denominator}]"

    @F.pandas_udf("string")
    def run(s):
        return s.map(one)

    return run(col(expression))


def tonumber(x) -> Column:
    """As a double; NULL for text that is no number (a column has one type)."""
    return F.coalesce(col(x).try_cast("bigint").cast("double"), col(x).try_cast("double"))


def ip2long(ip) -> Column:
    """A dotted quad as a number; NULL for anything else."""
    parts = F.transform(F.split(col(ip), r"\.", -1), lambda p: p.try_cast("int"))
    ok = col(ip).rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & F.forall(parts, lambda p: p.between(0, 255))
    return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p))


def long2ip(n) -> Column:
    c = col(n).cast("long")
    return F.concat_ws(".", *[F.shiftright(c, s).bitwiseAND(F.lit(255).cast("long")).cast("string") for s in (24, 16, 8, 0)])


def ip_prefix(ip, k: int | None = None) -> Column:
    """The first k parts, numbers normalised; without k how many parts there are."""
    parts = F.split(col(ip), r"\.", -1)
    if k is None:
        return F.size(parts).cast("string")
    return F.array_join(F.transform(F.slice(parts, 1, k), lambda p: F.coalesce(p.try_cast("int").cast("string"), p)), ".")


def apachelogsplit(line) -> Column:
    """A struct of a combined-format log line's fields; '-' gives NULL, and so does a line of another form."""
    pattern = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "(\S+) ?(\S*) ?(?:HTTP/)?([^"]*)" (\d+|-)(?: (\d+|-))?(?: "([^"]*)")?(?: "([^"]*)")?.*$'
    g = lambda i: F.regexp_extract(col(line), pattern, i)
    null = lambda c: F.when(~c.isin("-", ""), c)
    date = F.try_to_timestamp(F.substring(g(4), 1, 20), F.lit("dd/MMM/yyyy:HH:mm:ss"))
    names = ("ip", "ident", "authuser", None, "method", "uri", "httpver", None, None, "referrer", "useragent")
    made = [null(g(i)).alias(n) for i, n in enumerate(names, 1) if n]
    made[3:3] = [F.concat(F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss"), F.trim(F.substring(g(4), F.lit(22), F.lit(6)))).alias("date")]
    made[7:7] = [g(8).try_cast("int").alias("status"), g(9).try_cast("long").alias("bytes")]
    return F.when(col(line).rlike(pattern), F.struct(*made))


def gz(text) -> Column:
    """zlib-compressed at level 9."""
    import zlib

    @F.pandas_udf("binary")
    def run(s):
        return s.map(lambda t: None if t is None else zlib.compress(t.encode(), 9))

    return run(col(text))


def ungz(blob) -> Column:
    """The inverse of gz; what is not compressed passes as text."""
    import zlib

    def one(b):
        try:
            return None if b is None else zlib.decompress(bytes(b)).decode()
        except zlib.error:
            return bytes(b).decode("utf-8", "replace")

    @F.pandas_udf("string")
    def run(s):
        return s.map(one)

    return run(col(blob))


def urlrequest(url, null_on_error: bool = False, timeout: int = 30, data=None) -> Column:
    """The body of a GET, or of a POST of the JSON dictionary `data` as a form. Opt-in: executors open connections."""
    import json

    def one(u, d):
        from urllib.parse import urlencode as form
        from urllib.request import Request, urlopen

        try:
            body = None if d is None else form(json.loads(d)).encode()
            with urlopen(Request(u, body, {"Accept-Encoding": "identity"}), timeout=timeout) as r:
                return r.read().decode("utf-8", "replace")
        except OSError:
            if null_on_error:
                return None
            raise

    @F.pandas_udf("string")
    def run(s, t):
        import pandas as pd

        return pd.Series([None if u is None else one(u, d) for u, d in zip(s, t, strict=True)], dtype=object)

    return run(col(url), col(data) if data is not None else F.lit(None).cast("string"))


def execprogram(stdin, program: str, *args: str, null_on_error: bool = False) -> Column:
    """The output of a program that gets each value on its standard input. Opt-in: executors start processes."""
    import subprocess

    def one(t):
        done = subprocess.run([program, *args], input=(t or "").encode(), capture_output=True)
        if done.returncode:
            if null_on_error:
                return None
            raise RuntimeError(done.stderr.decode("utf-8", "replace")[:500])
        return done.stdout.decode("utf-8", "replace")

    @F.pandas_udf("string")
    def run(s):
        return s.map(one)

    return run(col(stdin))


def register_pyfun(name: str, function, returns: str, null_on_error: bool = False):
    """A Python function of one or more values as a column function; only functions that are passed here can be called."""

    def safe(*values):
        try:
            return function(*values)
        except Exception:
            if null_on_error:
                return None
            raise

    @F.pandas_udf(returns)
    def run(*columns):
        import pandas as pd

        return pd.Series([safe(*row) for row in zip(*columns, strict=True)])

    run.__name__ = name
    return lambda *values: run(*map(col, values))


__all__ = ["java", *[n for n in list(globals()) if not n.startswith("_")]]
