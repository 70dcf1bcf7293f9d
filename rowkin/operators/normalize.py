"""Normalized records of the master and of incoming files, in one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkin.functions import lexicons as lex
from rowkin.functions import text as T
from rowkin.functions.phonetics import sound_keys_udf
from rowkin.storage import staged


def looks_like_organization() -> Column:
    """An organization name is there, or the person columns hold a word that names organizations."""
    words = T.tokens(F.concat_ws(" ", "first_name", "last_name"))
    return (F.coalesce("organization_name", F.lit("")) != "") | F.arrays_overlap(words, lex.set_column([*lex.ORG_HINTS, *sorted(lex.LEGAL_MAP)]))


def with_sound_keys(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds sound keys of a column, computed once for each distinct value."""
    values = df.select(F.col(column).alias("_value")).filter("_value <> ''").distinct().withColumn("_keys", sound_keys_udf("_value"))
    return df.join(values, df[column] == values["_value"], "left").withColumn(out, F.coalesce("_keys", F.array().cast("array<string>"))).drop("_value", "_keys")


def normalize(df: DataFrame, id_col: str, claims: bool = False) -> DataFrame:
    """One normalized row a record. ``claims``: is_organization is what the source says, and may be overruled by the names."""
    return with_sound_keys(normal_forms(df, id_col, claims), "sounded", "phonetic_keys").drop("sounded")


def stored_normal(df: DataFrame, id_col: str, label: str, claims: bool = False) -> DataFrame:
    """``normalize`` as a staged table: forms are made once, and keys are told from the stored names where they are read, without a join.

    Rows are dealt to tasks first: a small file holds many, and making their forms takes far longer than reading them.
    """
    own = staged(normal_forms(df.repartition(id_col), id_col, claims), label)
    return own.withColumn("phonetic_keys", sound_keys_udf("sounded")).drop("sounded")


def normal_forms(df: DataFrame, id_col: str, claims: bool = False) -> DataFrame:
    """``normalize`` without sound keys, but with the word that they are keys of: ``sounded``."""
    is_org = F.coalesce("is_organization", F.lit(False))
    org_source = F.col("organization_name")
    if claims:
        is_org = is_org | looks_like_organization()
        org_source = F.when(F.coalesce(org_source, F.lit("")) == "", F.concat_ws(" ", "first_name", "middle_name", "last_name")).otherwise(org_source)
    base = df.withColumn("_org", is_org).withColumn("_legal", T.org_name(org_source)).withColumn("_dba", T.org_name(F.col("dba_name")))
    base = base.withColumn("_person", T.person_name(F.col("first_name"), F.col("middle_name"), F.col("last_name"), F.col("suffix")))
    base = base.withColumn("_npi", T.npi(F.col("npi"))).withColumn("_last", T.tokens(F.col("last_name"))).withColumn("_parts", T.split_words(F.col("_person.ordered")))
    person = lambda value, other="": F.when(~F.col("_org"), value).otherwise(other)
    org = lambda value: F.when(F.col("_org"), value).otherwise("")
    last = F.when(F.size("_last") > 0, F.element_at("_last", -1)).when(F.size("_parts") > 1, F.element_at("_parts", -1)).otherwise("")
    no_date = F.struct(*(F.lit(None).cast("int").alias(x) for x in ("year", "month", "day")))
    out = base.select(
        F.col(id_col).alias("record_id"),
        "ordinal",
        F.col("_org").alias("is_organization"),
        F.when(F.col("_npi.status") == "VALID", F.col("_npi.digits")).otherwise("").alias("npi"),
        F.col("_npi.status").alias("npi_status"),
        T.ein(F.col("ein")).alias("ein"),
        person(F.col("_person.ordered")).alias("name_norm"),
        person(F.col("_person.sorted")).alias("name_sorted_norm"),
        person(T.given_name(F.col("first_name"))).alias("first_norm"),
        person(F.coalesce(F.try_element_at(T.tokens(F.col("first_name")), F.lit(1)), F.lit(""))).alias("first_raw"),
        person(last).alias("last_norm"),
        F.when(~F.col("_org"), T.partial_date(F.col("dob"))).otherwise(no_date).alias("dob"),
        org(F.col("_legal.name")).alias("org_name_norm"),
        org(F.col("_legal.legal_form")).alias("org_legal_suffix"),
        org(F.col("_dba.name")).alias("dba_name_norm"),
        T.address(*(F.col(c) for c in ("address_line1", "address_line2", "city", "state", "zip"))).alias("address"),
        T.license_number(F.col("license_number")).alias("license_number"),
        T.state(F.col("license_state")).alias("license_state"),
        T.strip_punctuation(T.fold(F.col("specialty"))).alias("specialty"),
    )
    out = out.withColumn("org_tokens", T.org_tokens(F.col("org_name_norm"))).withColumn("org_acronym_key", T.org_acronym(F.col("org_name_norm"))).withColumn("dba_acronym_key", T.org_acronym(F.col("dba_name_norm")))
    out = out.withColumn("trigram_value", F.replace(F.when(F.col("is_organization"), F.col("org_name_norm")).otherwise(F.col("name_sorted_norm")), F.lit(" "), F.lit("")))
    sounded = F.when(F.col("is_organization"), F.split("org_name_norm", " ")[0]).otherwise(F.col("last_norm"))
    return out.withColumn("sounded", sounded)
