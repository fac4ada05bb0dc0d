"""Signatures and the cleaning of mails (E01, E04-E06). Built-in functions, but for Unicode's composed form."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealgraph.functions.text import tidy
from dealgraph.functions.workers import ship
from dealgraph.operators.extraction import unquoted

# Patterns, words and confidences that results depend on.
DELIMITER = r"^(?:--|___+|-{3,})$"
CLOSINGS = r"(?i)^(?:(?:Best regards|Regards|Sincerely|Thanks|Thank you|Cheers|BR)|Sent from my (?:iPhone|iPad|Android|BlackBerry)|Get Outlook for (?:iOS|Android))"
NO_NAME = r"(?i)^(?:Best regards|Regards|Sincerely|Thanks|Thank you|Cheers|BR|Best|Kind regards)"
PHONE, ADDRESS = r"(\+?[\d\s\-\(\)\.]{10,20})", r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"
TITLES = ("manager", "director", "engineer", "developer", "analyst", "consultant", "specialist", "coordinator", "executive", "officer", "president", "lead", "senior")
COMPANIES = ("Inc.", "LLC", "Ltd.", "Corp.", "Corporation", "Company", "Technologies", "Solutions", "Systems", "Services", "Group")
DISCLAIMERS = (r"This email.*confidential", r"This message.*intended.*recipient", r"CONFIDENTIALITY NOTICE", r"If you are not the intended recipient")
LONGEST_DISCLAIMER, LEAST_CONTENT = 500, 10


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _composed(xs: pd.Series) -> pd.Series:
    return xs.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def composed(text: Column) -> Column:
    """Unicode's composed form (NFC), which Spark has no function for."""
    ship()
    return F.pandas_udf(_composed, "string")(text)


def normalized(text: Column) -> Column:
    """E06 and what follows it in E01: composed, tidy, no zero-width characters, plain quotes and dashes."""
    out = F.regexp_replace(tidy(composed(text)), "[​-‍﻿]", "")
    out = F.regexp_replace(F.regexp_replace(out, "[‘’′″]", "'"), "[“”]", '"')
    return F.replace(F.replace(out, F.lit("—"), F.lit("--")), F.lit("–"), F.lit("-"))


def _contact(line: Column) -> Column:
    return line.rlike(ADDRESS) | line.rlike(PHONE)


def signature_start(text: Column) -> Column:
    """(line, confidence, marker) of the line on which a signature starts, null if there is none: a delimiter anywhere; a closing in the last ten lines; two lines above an address or phone in the last five."""
    ls = F.split(text, "\n")

    def first(test, last: int | None) -> Column:
        least = F.lit(0) if last is None else F.size(ls) - last
        return F.array_min(F.transform(ls, lambda x, i: F.when((i >= least) & test(x), i)))

    at = first(lambda x: trimmed(x).rlike(DELIMITER), None), first(lambda x: trimmed(x).rlike(CLOSINGS), 10), first(_contact, 5)

    def result(line: Column, confidence: float, marker: str) -> Column:
        return F.struct(line.cast("int").alias("line"), F.lit(confidence).alias("confidence"), F.lit(marker).alias("marker"))

    return F.when(trimmed(text) == "", F.lit(None)).when(at[0].isNotNull(), result(at[0], 1.0, "delimiter")).when(at[1].isNotNull(), result(at[1], 0.8, "pattern")).when(at[2].isNotNull(), result(F.greatest(at[2] - 2, F.lit(0)), 0.6, "heuristic"))


def split_signature(texts: DataFrame, text: str = "text") -> DataFrame:
    """Texts with body, signature (the text; null if there is none), and sign: the struct of signature_start()."""
    out = texts.withColumn("sign", signature_start(F.col(text)))
    ls = F.split(text, "\n")
    line = F.col("sign.line")
    return out.withColumns({"body": F.when(line.isNull(), F.col(text)).otherwise(trimmed(F.array_join(F.slice(ls, 1, line), "\n"))),
                            "signature": F.when(line.isNotNull(), trimmed(F.array_join(F.slice(ls, line + 1, F.size(ls)), "\n")))})


def parsed_signature(signature: Column) -> Column:
    """(name, title, company, email, phone, disclaimer) of a signature's text: the name is its first line unless that is a closing or an address, title and company are
    in the three lines after it that are no contact data."""
    ls = F.filter(F.transform(F.split(signature, "\n"), trimmed), lambda x: x != "")
    first = F.get(ls, F.lit(0))
    near = F.filter(F.slice(ls, 2, 3), lambda x: ~_contact(x))

    def titled(x: Column) -> Column:
        return F.lower(x).rlike("|".join(TITLES))

    def named(x: Column) -> Column:
        return x.rlike("|".join(f"\\Q{w}\\E|\\Q{w.lower()}\\E" for w in COMPANIES))

    title_at = F.array_min(F.transform(near, lambda x, i: F.when(titled(x), i)))
    company = F.get(F.filter(near, lambda x, i: named(x) & ~F.coalesce(i == title_at, F.lit(False))), F.lit(0))
    disclaimer = F.lit(None).cast("string")
    for pattern in reversed(DISCLAIMERS):
        found = F.regexp_extract(signature, rf"((?i:{pattern})[\s\S]*)", 1)
        disclaimer = F.when(found != "", trimmed(F.left(found, F.lit(LONGEST_DISCLAIMER)))).otherwise(disclaimer)

    def match(pattern: str) -> Column:
        return F.when(signature.rlike(pattern), F.regexp_extract(signature, pattern, 1))

    return F.struct(F.when(~first.rlike(NO_NAME) & ~first.rlike(ADDRESS), first).alias("name"), F.get(near, title_at.cast("int")).alias("title"), company.alias("company"), match(ADDRESS).alias("email"), trimmed(match(PHONE)).alias("phone"), disclaimer.alias("disclaimer"))


def cleaned(texts: DataFrame) -> DataFrame:
    """Texts (text_id, text): (text_id, cleaned, signature, had_quotes, had_signature, original_length, cleaned_length, has_content): quotes removed, the signature cut off, the rest normalised. Blank and null texts
    are empty."""
    kept = texts.where("text is not null")
    split = split_signature(unquoted(kept).withColumnRenamed("text", "_plain"), "_plain").join(kept, "text_id")
    blank = trimmed(F.col("text")) == ""
    out = split.withColumn("cleaned", F.when(blank, "").otherwise(normalized(F.col("body"))))
    rows = out.select("text_id", "cleaned", F.when(~blank, F.col("signature")).alias("signature"), (~blank & (F.length("text") != F.length("_plain"))).alias("had_quotes"), (~blank & F.col("signature").isNotNull()).alias("had_signature"),
                      F.length("text").alias("original_length"), F.length("cleaned").alias("cleaned_length"), (F.length(trimmed(F.col("cleaned"))) >= LEAST_CONTENT).alias("has_content"))
    none = F.lit(False)
    return rows.unionByName(texts.where("text is null").select("text_id", F.lit("").alias("cleaned"), F.lit(None).cast("string").alias("signature"), none.alias("had_quotes"), none.alias("had_signature"), F.lit(0).alias("original_length"), F.lit(0).alias("cleaned_length"), none.alias("has_content")))
