"""Text functions: normalisation, keywords, regular expressions, hashing, windows over words.

Everything that built-in expressions can say is a Column; the few that cannot are Python functions
of a row. NULL in gives NULL out unless a docstring says otherwise. Functions of several texts
join their results by a space.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field names of the query language that cqlkeywords leaves out, and those that cqlfields finds.
CQL_FIELDS = ("title", "subject", "person", "enter", "creator", "isbn")
CQL_FOUND = ("title", "isbn", "issn", "subject", "creator", "language", "type")
#: Years, as textreferences counts them.
YEAR = r"(\b|_)(1[5-9]\d{2}|20\d{2})(\b|_)"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java(pattern: str) -> str:
    """A Python regular expression in Java's dialect, matching Unicode classes."""
    return "(?U)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))


def java_replacement(text: str) -> str:
    """A Python replacement template in Java's dialect."""
    return re.sub(r"\\(?:g<)?(\w+)>?", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}", text.replace("$", "\\$"))


def _each(texts: tuple, one) -> Column:
    return F.concat_ws(" ", *[one(col(t)) for t in texts])


def _terms(text: Column) -> Column:
    return F.filter(F.split(text, " ", -1), lambda x: x != "")


def escapechars(*texts) -> Column:
    """The texts joined without a separator, line ends written as \\x0a and \\x0d."""
    return F.replace(F.replace(F.concat(*map(col, texts)), F.lit("\n"), F.lit("\\x0a")), F.lit("\r"), F.lit("\\x0d"))


def keywords(*texts) -> Column:
    """Numbers, words and amounts of money; lone full stops are dropped."""
    return _each(texts, lambda t: F.array_join(F.filter(F.regexp_extract_all(t, F.lit(java(r"[\d.]+\b|\w+|\$[\d.]+")), F.lit(0)), lambda x: x != "."), " "))


def cqlkeywords(*texts) -> Column:
    """Lower-cased words without the query language's own: `<word> all [and|or]` and the field names."""

    def one(t: Column) -> Column:
        plain = F.regexp_replace(F.lower(t), java(r"[^\w]"), " ")
        bare = F.regexp_replace(F.regexp_replace(plain, java(r"\w+\sall\s(and|or)"), ""), java(r"\w+\sall"), "")
        return F.array_join(F.filter(_terms(F.regexp_replace(bare, java(r"\s+"), " ")), lambda x: ~x.isin(*CQL_FIELDS)), " ")

    return F.regexp_replace(F.trim(_each(texts, one)), " +", " ")


def cqlfields(*texts) -> Column:
    """The field names that `all` follows."""
    plain = lambda t: F.regexp_replace(F.lower(t), java(r"[^a-z]"), " ")
    return _each(texts, lambda t: F.array_join(F.regexp_extract_all(plain(t), F.lit(java(rf"({'|'.join(CQL_FOUND)})\sall")), F.lit(1)), " "))


def kwnum(*texts) -> Column:
    """Number of space-separated terms; an empty text counts one."""
    total = F.lit(0)
    for t in texts:
        total = total + F.size(F.split(col(t), " ", -1))
    return total.cast("long")


def uniqueterms(*texts) -> Column:
    """Distinct terms in order of first occurrence."""
    return F.array_join(F.array_distinct(_terms(F.concat_ws(" ", *map(col, texts)))), " ")


def comprspaces(*texts) -> Column:
    """Trimmed, runs of white space made one space; a line end after an unusual character is deleted."""
    bare = lambda t: F.regexp_replace(t, java(r"^\s+|\s+$|(?<=[^\s\d\w.;,!?])\n+"), "")
    return _each(texts, lambda t: F.regexp_replace(bare(t), java(r"\s+"), " "))


def normalizetext(*texts) -> Column:
    """Runs of white space and , . ; become a space, other runs of non-word characters one underscore, underscores standing alone a space."""

    def one(t: Column) -> Column:
        a = F.regexp_replace(F.regexp_replace(t, java(r"[\s,.;]+"), " "), java(r"[^\w,.\s]+"), "_")
        return F.trim(F.regexp_replace(F.regexp_replace(a, java(r"\b_+\b"), " "), java(r"\s+"), " "))

    return _each(texts, one)


def isvalidutf8(*texts) -> Column:
    """1 if all characters are of the common ones, else 0; NULL gives 0."""
    # Characters counted as common beside words, white space and printable ASCII.
    common = "·∆©(́−·¨¬…‐\"•΄€„”“‘’´«»ʹ–"
    ok = F.lit(True)
    for t in texts:
        ok = ok & F.coalesce(col(t).rlike(java(rf"^[{common}\w\s\[!-~\]]*$")), F.lit(False))
    return ok.cast("int")


def utf8clean(*texts) -> Column:
    """Without control, format, surrogate and unassigned characters; line ends stay."""
    return _each(texts, lambda t: F.regexp_replace(t, r"[\p{C}&&[^\n]]", ""))


def regexpr(pattern: str, text, replacement: str | None = None) -> Column:
    """With a replacement: all matches replaced. Else NULL without a match, '1' for a pattern without groups, its groups as a pack."""
    t, groups = col(text), re.compile(pattern).groups
    if replacement is not None:
        return F.regexp_replace(t, java(pattern), java_replacement(replacement))
    found = t.rlike(java(pattern))
    if not groups:
        return F.when(found, F.lit("1"))
    made = [F.regexp_extract(t, java(pattern), g) for g in range(1, groups + 1)]
    from sparkloom.functions.packs import pack_text

    return F.when(found, made[0] if groups == 1 else pack_text(F.array(*made)))


def regexprfindall(pattern: str, text) -> Column:
    """All matches (the group, if the pattern has one) as a JSON list."""
    return F.to_json(F.regexp_extract_all(col(text), F.lit(java(pattern)), F.lit(min(1, re.compile(pattern).groups))))


def regexprmatches(pattern: str, text) -> Column:
    return col(text).rlike(java(pattern))


def regexpcountuniquematches(pattern: str, text) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(col(text), F.lit(java(pattern)), F.lit(0)))).cast("long")


def regexpcountwords(pattern: str, text) -> Column:
    """Words within all matches: spaces of each trimmed match, plus one."""
    found = F.regexp_extract_all(col(text), F.lit(java(pattern)), F.lit(0))
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, m: a + F.size(F.split(F.trim(m), " ", -1)).cast("long"))


def regexpcountwithpositions(pattern: str, text, start: int = 0, least: float = 0.5, multiply: float = 1) -> Column:
    """Score of matches by their place among matches and white space: later ones weigh more, or earlier ones if `start` is not 0."""
    tokens = F.regexp_extract_all(col(text), F.lit(java(f"{pattern}|\\s")), F.lit(0))
    n = F.size(tokens)
    hits = F.filter(F.transform(tokens, lambda x, i: F.when(x != " ", i + 1)), lambda i: i.isNotNull())
    total = F.aggregate(hits, F.lit(0.0), lambda a, i: a + i * F.lit(float(multiply)))
    reversed_ = F.aggregate(hits, F.lit(0.0), lambda a, i: a + (n - i))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(float(least)) + (total if start == 0 else reversed_) / n)


def contains(text, part) -> Column:
    return F.contains(col(text), col(part))


def stripchars(text, chars: str | None = None) -> Column:
    """Without `chars` (white space) at both ends."""
    inside = re.sub(r"([\]\[\\^&-])", r"\\\1", chars) if chars else r"\s"
    return F.regexp_replace(col(text), f"(?U)^[{inside}]+|[{inside}]+$", "")


def _by_rows(one, text) -> Column:
    """one(text) of each row in Python, rows sent in batches of 100: an Arrow batch has 10,000, which are gigabytes where texts are long."""
    return F.udf(lambda t: None if t is None else one(t), "string", useArrow=False)(col(text))


def unitosuni(text) -> Column:
    """Non-ASCII characters as \\u escapes."""
    return _by_rows(lambda t: t.encode("unicode_escape").decode("ascii"), text)


def sunitouni(text) -> Column:
    """The inverse of unitosuni; a text with a broken escape is returned as it is. Nothing is evaluated."""

    def one(t):
        try:
            return t.encode("latin-1", "backslashreplace").decode("unicode_escape")
        except UnicodeDecodeError:
            return t

    return _by_rows(one, text)


def normuni(text) -> Column:
    """Unicode normal form C."""
    import unicodedata

    return _by_rows(lambda t: unicodedata.normalize("NFC", t), text)


def written_literal(value: Column, quoted: bool) -> Column:
    """How a value is written before hashing: numbers plain, texts quoted with a u before them."""
    if not quoted:
        return value.cast("string")
    escaped = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("u'"), escaped, F.lit("'"))


def _hash_input(values: tuple, quoted: bool | None) -> Column:
    def one(v: Column) -> Column:
        if quoted is not None:
            return written_literal(v, quoted)
        # the type is known when the plan is made, so this is folded away
        return F.when(F.typeof(v).isin("string"), written_literal(v.cast("string"), True)).otherwise(v.cast("string"))

    return F.concat_ws("\x1e", *[one(col(v)) for v in values])


def hashmd5(*values, quoted: bool | None = None) -> Column:
    """MD5 of the values, texts written as quoted literals, so that '5' and 5 differ; `quoted` says it for all values instead of their types."""
    return F.md5(_hash_input(values, quoted))


def hashmd5mod(*values, divisor: int, quoted: bool | None = None) -> Column:
    """The MD5 as a 128-bit number, modulo `divisor` (below 2^31): eight 16-bit digits folded."""
    digest, out = hashmd5(*values, quoted=quoted), F.lit(0).cast("long")
    for i in range(8):
        out = (out * 65536 + F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("long")) % F.lit(divisor)
    return out


def crc32(*values, quoted: bool | None = None) -> Column:
    return F.crc32(F.encode(_hash_input(values, quoted), "UTF-8"))


def hashmod(*values, divisor: int) -> Column:
    """A fast hash modulo `divisor`; stands for both architecture-dependent hashes."""
    return F.pmod(F.xxhash64(*map(col, values)), F.lit(divisor))


hashmodarchdep = hashmodarchdep2 = hashmod


def textreferences(text, maxlen: int = 5, pattern: str = YEAR) -> Column:
    """The lines that belong to a list of references: where the density of lines with `pattern`, smoothed over `maxlen`, reaches its mean. Texts of fewer than 10 line ends stay as they are."""
    found = re.compile(pattern)

    def one(t: str) -> str:
        t = t.replace("\r\n", "\n")
        if t.count("\n") < 10:
            return t
        lines = [x for x in reversed(t.split("\n")[10:]) if len(x) > 10]
        if not lines:
            return ""
        half = maxlen // 2
        marks = [1] * half + [1 if found.search(x) else 0 for x in lines] + [0] * (maxlen - half)
        density = [sum(marks[i : i + maxlen]) / maxlen for i in range(len(lines))]
        mean = sum(density) / len(density)
        return "\n".join(reversed([x for x, y in zip(lines, density, strict=True) if y >= mean]))

    return _by_rows(one, text)


def textwindow2s(text, before: int, middle: int, after: int, pattern: str | None = None) -> Column:
    """An array of (prev, middle, next), each a text of that many words around every `middle` words; inline() makes rows of it."""
    words = _terms(col(text))
    n = F.size(words)
    at = F.sequence(F.lit(1), F.greatest(n - middle + 1, F.lit(1)))

    def part(i: Column, size: Column) -> Column:
        return F.array_join(F.slice(words, i, size), " ")

    rows = F.transform(F.when(n > 0, at), lambda i: F.struct(part(F.greatest(i - before, F.lit(1)), F.least(F.lit(before), i - 1)).alias("prev"), part(i, F.lit(middle)).alias("middle"), part(F.least(i + middle, n + 1), F.lit(after)).alias("next")))
    return F.filter(rows, lambda r: r["middle"].rlike(java(pattern))) if pattern else rows


def textwindow(text, before: int, after: int, middle: int = 1, pattern: str | None = None) -> Column:
    """An array of structs prev1.., middle, next1..; words beyond the ends are empty. A negative `before` keeps windows whose preceding words don't match."""
    words, size = _terms(col(text)), abs(before)
    n = F.size(words)
    word = lambda i: F.coalesce(F.get(words, i), F.lit(""))

    def row(i: Column) -> Column:
        cells = [F.when(i >= size - k, word(F.greatest(i - size + k, F.lit(0)))).otherwise("").alias(f"prev{k + 1}") for k in range(size)]
        cells.append(F.array_join(F.slice(words, i + 1, middle), " ").alias("middle"))
        return F.struct(*cells, *[word(i + middle + k).alias(f"next{k + 1}") for k in range(after)])

    rows = F.transform(F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - middle, F.lit(0)))), row)
    if pattern:
        rows = F.filter(rows, lambda r: r["middle"].rlike(java(pattern)))
        if before < 0:
            for k in range(size):
                rows = F.filter(rows, lambda r: ~r[f"prev{k + 1}"].rlike(java(pattern)))  # noqa: B023
    return rows


def strsplitv(text, delimiter: str = " ") -> Column:
    """The parts of a text, quoted parts whole; explode() makes rows of it."""
    if len(delimiter) != 1:
        return F.split(col(text), f"\\Q{delimiter}\\E", -1)
    safe = delimiter if delimiter not in "\\]^-[&" else "\\" + delimiter
    parts = F.regexp_extract_all(F.concat(col(text), F.lit(delimiter)), F.lit(rf'("(?:[^"]|"")*"|[^{safe}]*){safe if safe != "|" else "[|]"}'), F.lit(1))
    return F.transform(parts, lambda p: F.when(p.rlike('^".*"$'), F.replace(F.substring(p, F.lit(2), F.length(p) - 2), F.lit('""'), F.lit('"'))).otherwise(p))


def strsplit(text, width: int, delimiter: str = " ") -> Column:
    """A struct C1..Cn of a text's parts, NULL where there are fewer."""
    parts = strsplitv(text, delimiter)
    return F.struct(*[F.get(parts, i).alias(f"C{i + 1}") for i in range(width)])


def strjoin(*values, delimiter: str = ",") -> Column:
    """The values as one line; those with a delimiter, quote or line end are quoted. Any NULL gives NULL."""

    def cell(v) -> Column:
        c = col(v).cast("string")
        return F.when(c.rlike(f'[\\Q{delimiter}\\E"\\n\\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    line = cell(values[0])
    for v in values[1:]:
        line = F.concat(line, F.lit(delimiter), cell(v))
    return line


# Frequent function words of four languages, first letter in lower case.
STOPWORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i if in into is it its me my no not of on or our she so some such that the their them then there these they this to was we were what when which who will with you your "
    "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous "
    "aber als am auch auf aus bei bin bis das dem den der des die dies du ein eine einem einen einer er es für hat ich ihr im ist ja mich mir mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war was wenn wer wie wir zu zum zur "
    "al como con cual cuando del donde e el ella ellos era es esta este ha hasta hay lo los más mi muy nada ni nosotros o otra para pero por porque quien sin sobre soy su sus también tiene todo tus y ya yo".split()
)


def filterstopwords(*texts) -> Column:
    """Without the words whose form with a small first letter is a stop word."""
    stop = F.array(*map(F.lit, sorted(STOPWORDS)))
    small = lambda w: F.concat(F.lower(F.substring(w, F.lit(1), F.lit(1))), F.substring(w, F.lit(2), F.length(w)))
    return _each(texts, lambda t: F.array_join(F.filter(_terms(t), lambda w: ~F.array_contains(stop, small(w))), " "))
