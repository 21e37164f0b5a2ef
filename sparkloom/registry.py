"""SQL names: functions that SQL statements and the dialect can call once register_all(spark) has run.

They are SQL functions with expression bodies, so the optimiser inlines them like built-in ones.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (parameters, result type, body)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "kwnum": ("t STRING", "BIGINT", "CAST(size(split(t, ' ', -1)) AS BIGINT)"),
    "uniqueterms": ("t STRING", "STRING", "array_join(array_distinct(filter(split(t, ' ', -1), x -> x <> '')), ' ')"),
    "escapechars": ("t STRING", "STRING", r"replace(replace(t, chr(10), r'\x0a'), chr(13), r'\x0d')"),
    "comprspaces": ("t STRING", "STRING", r"regexp_replace(regexp_replace(t, r'(?U)^\s+|\s+$', ''), r'(?U)\s+', ' ')"),
    "keywords": ("t STRING", "STRING", r"array_join(filter(regexp_extract_all(t, r'(?U)[\d.]+\b|\w+|\$[\d.]+', 0), x -> x <> '.'), ' ')"),
    "regexprmatches": ("p STRING, t STRING", "BOOLEAN", "t RLIKE p"),
    "regexpcountuniquematches": ("p STRING, t STRING", "BIGINT", "CAST(size(array_distinct(regexp_extract_all(t, p, 0))) AS BIGINT)"),
    "hashmd5": ("t STRING", "STRING", "md5(CAST(concat('u', chr(39), replace(replace(replace(t, chr(92), concat(chr(92), chr(92))), chr(10), concat(chr(92), 'n')), chr(39), concat(chr(92), chr(39))), chr(39)) AS BINARY))"),
    "jlen": ("j STRING", "BIGINT", "CAST(coalesce(json_array_length(j), CASE WHEN j <> '' THEN 1 ELSE 0 END) AS BIGINT)"),
    "s2j": ("t STRING", "ARRAY<STRING>", "filter(split(t, ' ', -1), x -> x <> '')"),
    "t2j": ("t STRING", "ARRAY<STRING>", "split(t, chr(9), -1)"),
    "nl2j": ("t STRING", "ARRAY<STRING>", "split(t, chr(10), -1)"),
    "j2s": ("a ARRAY<STRING>", "STRING", "replace(array_join(a, ' '), chr(10), ' ')"),
    "j2nl": ("a ARRAY<STRING>", "STRING", "array_join(a, chr(10))"),
    "jset": ("a ARRAY<STRING>", "ARRAY<STRING>", "array_sort(array_distinct(a))"),
    "jexcept": ("a ARRAY<STRING>, b ARRAY<STRING>", "ARRAY<STRING>", "filter(a, x -> NOT coalesce(array_contains(b, x), false))"),
    "jintersection": ("a ARRAY<STRING>, b ARRAY<STRING>", "ARRAY<STRING>", "array_sort(array_intersect(a, b))"),
    "jaccard": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "try_divide(size(array_intersect(a, b)), size(array_union(a, b)))"),
    "sorensendice": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "try_divide(2 * size(array_intersect(a, b)), size(array_distinct(a)) + size(array_distinct(b)))"),
    "tset": ("t STRING", "STRING", "array_join(array_sort(array_distinct(filter(split(t, ' ', -1), x -> x <> ''))), ' ')"),
    "levendist": ("a STRING, b STRING", "BIGINT", "CAST(levenshtein(a, b) AS BIGINT)"),
    "ip2long": ("ip STRING", "BIGINT", r"CASE WHEN ip RLIKE r'^\d{1,3}(\.\d{1,3}){3}$' AND forall(split(ip, r'\.'), p -> try_cast(p AS INT) BETWEEN 0 AND 255) THEN aggregate(transform(split(ip, r'\.'), p -> try_cast(p AS BIGINT)), CAST(0 AS BIGINT), (a, p) -> a * 256 + p) END"),
    "long2ip": ("n BIGINT", "STRING", "concat_ws('.', CAST(shiftright(n, 24) & 255 AS STRING), CAST(shiftright(n, 16) & 255 AS STRING), CAST(shiftright(n, 8) & 255 AS STRING), CAST(n & 255 AS STRING))"),
    "sqroot": ("x DOUBLE", "DOUBLE", "CASE WHEN x >= 0 THEN sqrt(x) END"),
    "safediv": ("d DOUBLE, a DOUBLE, b DOUBLE", "DOUBLE", "CASE WHEN b = 0 THEN d ELSE try_divide(a, b) END"),
    "htmlencode": ("t STRING", "STRING", "replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"),
    "urlencode": ("t STRING", "STRING", "url_encode(t)"),
    "urldecode": ("t STRING", "STRING", "try_url_decode(t)"),
    "query": ("t STRING", "STRING", "concat(t, ';')"),
}


def register_all(spark: SparkSession) -> list[str]:
    """Creates every function for this session and returns the names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return sorted(FUNCTIONS)
