"""Table schemas, comparison fields in their fixed order, and the names of their levels (level 0 is the lowest)."""

from __future__ import annotations

PROVIDERS = "provider_id string, npi string, first_name string, middle_name string, last_name string, suffix string, dob date, address_line1 string, address_line2 string, city string, state string, zip string, license_number string, license_state string, specialty string, organization_name string, dba_name string, ein string, is_organization boolean, status string, ordinal long"
SANCTIONS = "record_id string, source_authority string, npi string, first_name string, middle_name string, last_name string, suffix string, dob string, address_line1 string, address_line2 string, city string, state string, zip string, license_number string, license_state string, specialty string, organization_name string, dba_name string, ein string, is_organization boolean, sanction_type string, exclusion_date date, reinstatement_date date, ordinal long"
TRUTH = "sanction_record_id string, expected_outcome string, expected_provider_id string, scenario_tag string, corruption_profile string"
OUTCOMES = ("MATCH", "AMBIGUOUS", "NO_MATCH")
BLOCKS = ("npi", "state_dob", "phonetic_state", "zip_name3", "license", "trigram", "ein", "org_token_state", "org_acronym")

# Level names by field, lowest first; positions are stored in models and vectors.
IDENTIFIER = ("BOTH_INVALID", "ONE_INVALID", "VALID_DISAGREE", "VALID_EXACT")
ADDRESS = ("MISSING", "DISAGREE", "SAME_ZIP_ONLY", "TOKEN_SET", "SAME_STREET_DIFF_UNIT", "EXACT")
STATE = ("MISSING", "DISAGREE", "EXACT")
ZIP = ("MISSING", "DISAGREE", "ZIP3", "ZIP5")
INDIVIDUAL = {
    "npi": IDENTIFIER,
    "last_name": ("MISSING", "DISAGREE", "JW_LOW", "JW_HIGH", "PHONETIC", "EXACT"),
    "first_name": ("MISSING", "DISAGREE", "JW_LOW", "INITIAL", "NICKNAME", "EXACT"),
    "dob": ("MISSING", "DISAGREE", "YEAR_ONLY", "YEAR_MONTH", "TRANSPOSED", "EXACT"),
    "address": ADDRESS,
    "state": STATE,
    "zip": ZIP,
    "license": ("MISSING", "DISAGREE", "EXACT_DIFF_STATE", "EXACT"),
}
ORGANIZATION = {
    "npi": IDENTIFIER,
    "ein": IDENTIFIER,
    "legal_name": ("MISSING", "DISAGREE", "JW_LOW", "TOKEN_SET", "ACRONYM", "EXACT"),
    "dba_alias": ("MISSING", "DISAGREE", "TOKEN_SET", "EXACT"),
    "address": ADDRESS,
    "state": STATE,
    "zip": ZIP,
}
FIELDS = {"individual": INDIVIDUAL, "organization": ORGANIZATION}


def level(kind: str, field: str, name: str) -> int:
    return FIELDS[kind][field].index(name)
