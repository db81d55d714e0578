"""A document's identity from its file name."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import slug, strip, trim_chars

CIRCULAR = r"(?i)^([A-Z]-[A-Z]+-(\d{4})-\d+)[-\s]*(?:Encl\.?)?\s*"
NOISE = (r"(?i)\s*[-–]\s*Portal\s+version\s*", r"\s*\(\d+\)\s*$", r"(?i)\s*[-–]\s*Encl\.?\s*")
YEAR = r"(?:^|[\s\-–_])((?:19|20)\d{2})(?=$|[\s\-–_)])"
#: Abbreviations that a family's editions spell either way.
LONG = {
    "afpad": "approval framework for policies and associated documents",
    "bcp": "business continuity",
    "kyc": "know your customer",
}


def stem(name: Column) -> Column:
    """Without folders and the last extension."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.when(base.rlike(r"^.+\.[^.]+$"), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)


def identity(name: Column) -> Column:
    """doc_id, title, source_name, policy_family, year, circular. The circular's year comes before any in the title."""
    full = strip(stem(name))
    circular = F.upper(F.regexp_extract(full, CIRCULAR, 1))
    issued = F.regexp_extract(full, CIRCULAR, 2)
    rest = F.regexp_replace(full, CIRCULAR, "")
    for pattern in NOISE:
        rest = F.regexp_replace(rest, pattern, " ")
    years = F.regexp_extract_all(rest, F.lit(YEAR), F.lit(1))
    year = F.coalesce(F.when(issued != "", issued), F.when(F.size(years) > 0, F.element_at(years, -1))).cast("int")
    title = trim_chars(F.regexp_replace(F.regexp_replace(rest, YEAR, " "), r"\s{2,}", " "), " -–_")
    family = F.lower(title)
    for short, long in LONG.items():
        family = F.regexp_replace(family, rf"\b{short}\b", long)
    return F.struct(
        slug(stem(name)).alias("doc_id"), F.when(title != "", title).otherwise(stem(name)).alias("title"), name.alias("source_name"),
        slug(family).alias("policy_family"), year.alias("year"), circular.alias("circular"),
    )


#: Fixed value: the namespace for URLs of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based UUID (version 5): the SHA-1 of namespace and name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def nfkc():
    """A pandas UDF text -> its NFKC form, for names of files (no built-in function normalises)."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.map(lambda n: unicodedata.normalize("NFKC", n), na_action="ignore")

    return run
