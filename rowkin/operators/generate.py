"""A provider master, dirty sanction records and their truth, as columns of a hash of (seed, label, row): the same on every run
and for every partitioning, and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkin import schema
from rowkin.functions import lexicons
from rowkin.functions.text import luhn_digit

STREET_NAMES = "OAK ELM MAPLE CEDAR PINE MAIN PARK LAKE HILL RIVER SUNSET CHURCH SPRING MEADOW WALNUT".split()
CITIES = "AUSTIN DALLAS MIAMI TAMPA BOSTON DENVER PHOENIX ATLANTA CHICAGO SEATTLE NASHVILLE PORTLAND".split()
TRADES = ("CLINIC", "PHARMACY", "HOME HEALTH", "DENTAL GROUP", "IMAGING CENTER", "URGENT CARE")
STARTS = "BAR COL DEN FAR GAL HAR JEN KEL LAN MOR NEL PAR QUIN RAM SAN TAL VAN WAL YAR ZEL".split()
MIDDLES = ["", "DO", "LI", "MA", "RI", "TE", "VO", "WI"]
ENDS = "SON TON LEY FIELD MAN BERG ELL ARD ETT INGS".split()
#: Scenarios with their shares of the records.
SCENARIOS = (("clean", 0.20), ("typo", 0.18), ("nickname", 0.10), ("partial_dob", 0.10), ("moved", 0.10), ("no_identifier", 0.10), ("married_name", 0.06), ("absent", 0.16))
#: Corruptions: rate at a dial of 1.
RATES = {"drop_letter": 0.25, "swap_letters": 0.20, "nickname": 0.25, "initial": 0.10, "drop_npi": 0.70, "bad_npi": 0.15, "dob_us": 0.40, "dob_year": 0.20, "dob_gone": 0.25, "dob_swap": 0.10, "new_street": 0.25, "street_short": 0.40, "drop_zip": 0.25, "drop_license": 0.50, "license_zeros": 0.30, "suffix": 0.10, "org_form": 0.40, "org_acronym": 0.10}


class Draws:
    """Uniform draws in [0, 1), one a label and row."""

    def __init__(self, seed: int, row: Column):
        self.seed, self.row = seed, row

    def share(self, label: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.lit(label), self.row), F.lit(1 << 52)) / F.lit(float(1 << 52))

    def number(self, label: str, n: int) -> Column:
        return F.floor(self.share(label) * n).cast("int")

    def pick(self, label: str, values) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), self.number(label, len(values)) + 1)


def _people(rows: DataFrame, seed: int, key: str = "ordinal") -> DataFrame:
    """Entities of a range of ordinals. In each fifty: a twin of the row before, a child with the parent's name, a common name,
    and a branch of an organization."""
    c, place = F.col(key), F.col(key) % 50
    own, before = Draws(seed, c), Draws(seed, F.when(place.isin(11, 13, 17), c - 1).otherwise(c))
    org = (F.col(key) % 5 == 4) | (place == 17) | (place == 16)
    surname = F.when(place == 21, "SMITH").otherwise(F.concat(before.pick("s1", STARTS), before.pick("s2", MIDDLES), before.pick("s3", ENDS)))
    first = F.when(place == 21, "JAMES").otherwise(F.when(place == 13, before.pick("first", lexicons.CANONICAL)).otherwise(own.pick("first", lexicons.CANONICAL)))
    born = F.date_add(F.lit("1940-01-01").cast("date"), before.number("dob", 18000))
    body = F.lpad((F.lit(100000000) + F.pmod(c * 7919, F.lit(899999999))).cast("string"), 9, "0")
    name = F.concat_ws(" ", before.pick("o1", STARTS), before.pick("o2", ENDS), before.pick("o3", TRADES))
    codes = sorted(set(lexicons.STATE_MAP.values()))
    person = lambda v: F.when(~org, v)
    made = {
        "npi": F.concat(body, luhn_digit(body).cast("string")),
        "first_name": person(first),
        "middle_name": person(F.when(own.share("mid") < 0.5, own.pick("middle", list("ABCDEFGHJKLMNPRST")))),
        "last_name": person(surname),
        "suffix": person(F.when(place == 13, "JR").when(own.share("suffix") < 0.3, "MD")),
        "dob": person(F.when(place == 13, F.add_months(born, 336)).otherwise(born)),
        "address_line1": F.concat_ws(" ", (before.number("house", 9800) + 100).cast("string"), before.pick("street", STREET_NAMES), before.pick("way", ("STREET", "AVENUE", "ROAD", "DRIVE"))),
        "address_line2": F.when(own.share("unit") < 0.2, F.concat(F.lit("SUITE "), own.number("unit number", 900).cast("string"))),
        "city": own.pick("city", CITIES),
        "state": before.pick("state", codes),
        "zip": F.lpad(before.number("zip", 99999).cast("string"), 5, "0"),
        "license_number": F.concat(F.lit("L"), F.pmod(c * 104729, F.lit(9999991)).cast("string")),
        "license_state": before.pick("state", codes),
        "specialty": own.pick("specialty", ("GENERAL PRACTICE", "NURSING", "DENTISTRY", "PHARMACY", "PSYCHIATRY")),
        "organization_name": F.when(org, F.concat_ws(" ", name, before.pick("form", ("LLC", "INC", "PC", "")))),
        "dba_name": F.when(org & (own.share("dba") < 0.2), F.concat_ws(" ", own.pick("o1", ENDS), own.pick("o3", TRADES))),
        "ein": F.when(org, F.regexp_replace(body, r"^(\d{2})", "$1-")),
        "is_organization": org,
        "status": F.lit("ACTIVE"),
    }
    return rows.select("*", *(v.alias(k) for k, v in made.items()))


def providers(spark: SparkSession, n: int, seed: int = 20260914) -> DataFrame:
    rows = spark.range(n).select(F.col("id").alias("ordinal"), F.format_string("P%07d", "id").alias("provider_id"))
    return _people(rows, seed).select(*(f.split()[0] for f in schema.PROVIDERS.split(", ")))


def _corrupted(df: DataFrame, seed: int, dial: float) -> DataFrame:
    """Each corruption strikes a row with its rate times the dial; the scenario forces its own."""
    d, c = Draws(seed, F.col("ordinal")), F.col
    forced = {"typo": "drop_letter", "nickname": "nickname", "partial_dob": "dob_year", "moved": "new_street", "no_identifier": "drop_npi"}
    hit = lambda op: (d.share(op) < RATES[op] * dial) | c("scenario_tag").isin([s for s, o in forced.items() if o == op and dial > 0])
    at = lambda x, label: F.floor(d.share(label) * (F.length(x) - 1)).cast("int") + 1
    short: dict[str, str] = {}
    for nick, full in lexicons.NICKNAME_MAP.items():
        short.setdefault(full, nick)

    def letters(x: Column) -> Column:
        cut = F.concat(F.substring(x, F.lit(1), at(x, "cut")), F.substring(x, at(x, "cut") + 2, F.lit(200)))
        turned = F.concat(F.substring(x, F.lit(1), at(x, "turn") - 1), F.substring(x, at(x, "turn") + 1, F.lit(1)), F.substring(x, at(x, "turn"), F.lit(1)), F.substring(x, at(x, "turn") + 2, F.lit(200)))
        return F.when(hit("drop_letter"), cut).when(hit("swap_letters"), turned).otherwise(x)

    first = F.when(hit("nickname"), F.coalesce(lexicons.map_column(short)[c("first_name")], c("first_name"))).when(hit("initial"), F.left("first_name", F.lit(1))).otherwise(c("first_name"))
    last = F.when((c("scenario_tag") == "married_name") & (dial > 0), F.concat(d.pick("m1", STARTS), d.pick("m2", ENDS))).otherwise(letters(c("last_name")))
    day = F.when(hit("dob_gone"), None).when(hit("dob_year"), F.date_format("dob", "yyyy")).when(hit("dob_swap"), F.date_format("dob", "dd/MM/yyyy")).when(hit("dob_us"), F.date_format("dob", "MM/dd/yyyy")).otherwise(F.date_format("dob", "yyyy-MM-dd"))
    street = F.when(hit("new_street"), F.concat_ws(" ", d.number("house", 9000).cast("string"), d.pick("street", STREET_NAMES), F.lit("LANE"))).when(hit("street_short"), F.regexp_replace(F.regexp_replace("address_line1", "STREET$", "ST"), "AVENUE$", "AVE")).otherwise(c("address_line1"))
    org = F.regexp_replace("organization_name", r" (LLC|INC|PC)?$", "")
    acronym = F.array_join(F.transform(F.split(org, " "), lambda w: F.left(w, F.lit(1))), "")
    return df.withColumns({
        "first_name": first,
        "last_name": last,
        "dob": day,
        "address_line1": street,
        "npi": F.when(hit("drop_npi"), None).when(hit("bad_npi"), F.lit("0000000000")).otherwise(c("npi")),
        "zip": F.when(~hit("drop_zip"), c("zip")),
        "license_number": F.when(hit("drop_license"), None).when(hit("license_zeros"), F.regexp_replace("license_number", "^L", "L-00")).otherwise(c("license_number")),
        "suffix": F.when(hit("suffix"), "SR").otherwise(c("suffix")),
        "ein": F.when(~hit("drop_npi"), c("ein")),
        "organization_name": F.when(hit("org_acronym"), acronym).when(hit("org_form"), F.concat(org, F.lit(", L.L.C."))).otherwise(letters(c("organization_name"))),
    })


def sanctions(spark: SparkSession, n: int, n_providers: int, dial: float = 0.5, seed: int = 20260914) -> tuple[DataFrame, DataFrame]:
    """Records and truth. A record of the scenario ``absent`` is about somebody the master does not have."""
    d = Draws(seed + 1, F.col("id"))
    tag = F.lit(SCENARIOS[-1][0])
    for i in reversed(range(len(SCENARIOS) - 1)):
        tag = F.when(d.share("scenario") < sum(share for _, share in SCENARIOS[: i + 1]), SCENARIOS[i][0]).otherwise(tag)
    rows = spark.range(n).select("id", tag.alias("scenario_tag"), F.floor(d.share("who") * n_providers).cast("long").alias("who"))
    about = rows.select("id", "scenario_tag", F.when(F.col("scenario_tag") == "absent", F.lit(n_providers) + F.col("id") * 50 + 1).otherwise(F.col("who")).alias("target"))
    # An entity is a function of its ordinal, so the record derives it anew: no join with the master.
    dirty = _corrupted(_people(about, seed, "target").withColumnRenamed("id", "ordinal"), seed + 2, dial)
    keyed = dirty.withColumns({
        "record_id": F.format_string("S%07d", "ordinal"),
        "source_authority": Draws(seed, F.col("ordinal")).pick("list", ("OIG-LEIE", "SAM", "TX-HHSC", "FL-AHCA")),
        "sanction_type": F.lit("1128a1"),
        "exclusion_date": F.date_add(F.lit("2015-01-01").cast("date"), Draws(seed, F.col("ordinal")).number("excluded", 3600)),
        "reinstatement_date": F.lit(None).cast("date"),
    })
    known = F.col("scenario_tag") != "absent"
    truth = rows.select(F.format_string("S%07d", "id").alias("sanction_record_id"), F.when(known, "MATCH").otherwise("NO_MATCH").alias("expected_outcome"), F.when(known, F.format_string("P%07d", "who")).alias("expected_provider_id"), "scenario_tag", F.to_json(F.struct(F.lit(dial).alias("dial"))).alias("corruption_profile"))
    return keyed.select(*(f.split()[0] for f in schema.SANCTIONS.split(", "))), truth


def inspected(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Records by scenario, and how many have each identifying field."""
    df = records.join(truth, F.col("record_id") == F.col("sanction_record_id"))
    return df.groupBy("scenario_tag").agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in ("npi", "dob", "zip", "license_number")))
