"""Functions for SQL: checksums, entropy and token shapes as expressions, and detection as a table function.

    SELECT d.doc_id, e.* FROM documents d, LATERAL detect_entities(d.text) e
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_DIGIT = "IF(c BETWEEN '0' AND '9', ascii(c) - 48, ascii(c) - 55)"
FUNCTIONS = {
    "luhn_ok(number STRING) RETURNS BOOLEAN": "length(number) >= 2 AND aggregate(transform(split(reverse(number), ''), (c, i) -> IF(i % 2 = 1, INT(c) * 2 DIV 10 + INT(c) * 2 % 10, INT(c))), 0L, (a, v) -> a + v) % 10 = 0",
    "iban_ok(iban STRING) RETURNS BOOLEAN": f"length(iban) >= 5 AND upper(iban) RLIKE '^[A-Z0-9]+$' AND aggregate(split(concat(substring(upper(iban), 5), left(upper(iban), 4)), ''), 0, (r, c) -> IF({_DIGIT} < 10, (r * 10 + {_DIGIT}) % 97, (r * 100 + {_DIGIT}) % 97)) = 1",
    "entropy_bits(value STRING) RETURNS DOUBLE": "IF(length(value) = 0 OR size(array_distinct(split(value, ''))) = 1, 0D, aggregate(array_distinct(split(value, '')), 0D, (a, c) -> a - coalesce(size(filter(split(value, ''), x -> x = c)) / length(value) * log2(nullif(floor(size(filter(split(value, ''), x -> x = c)) * 256 / length(value)), 0) / 256), 0D)))",
    "is_token(value STRING) RETURNS BOOLEAN": "value RLIKE '^<<[A-Z_]+_[0-9]+>>$'",
}


class _Detect:
    def eval(self, text: str):
        from quillmask.functions import plain

        for e in plain.detect(text):
            yield e["type"], e["source"], e["confidence"], e["start"], e["end"], e["value"]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session; returns their names.  Texts of any size are scanned by detect_entities."""
    from pyspark.sql.functions import udtf

    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("detect_entities", udtf(_Detect, returnType="type string, source string, confidence double, start int, end int, value string"))
    return [h.split("(")[0] for h in FUNCTIONS] + ["detect_entities"]

