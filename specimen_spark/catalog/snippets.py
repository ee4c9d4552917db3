"""Shared pieces of DuckDB reference SQL."""

from specimen_spark.fixed_values import NON_SPECIES_WORDS, REGION_BOXES, US_STATES


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


NON_SPECIES = quoted(NON_SPECIES_WORDS)
STATES = quoted(US_STATES)


def nt(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def title(t: str) -> str:
    return f"(upper(substr({t}, 1, 1)) || lower(substr({t}, 2)))"


def tokens(c: str) -> str:
    return f"regexp_extract_all({nt(c)}, '[A-Za-z-]+')"


def country(c: str) -> str:
    t = nt(c)
    return (f"CASE WHEN contains(lower({t}), 'united states') OR lower({t}) IN ('usa', 'us', 'u.s.a.', 'u.s.') "
            f"THEN 'United States' ELSE {t} END")


def state(c: str) -> str:
    t = nt(c)
    return (f"array_to_string(list_transform(string_split({t}, ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")


def region(lat: str, lon: str) -> str:
    cases = " ".join(
        f"WHEN {lat} BETWEEN {a} AND {b} AND {lon} BETWEEN {c} AND {d} THEN '{name}'" for name, a, b, c, d in REGION_BOXES
    )
    return f"CASE {cases} ELSE '' END"


def finite(c: str) -> str:
    return f"CASE WHEN isfinite(try_cast({c} AS DOUBLE)) THEN try_cast({c} AS DOUBLE) END"


def uniform(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / 4294967296.0)"


_HINT = f"CASE WHEN len({tokens('genus')}) > 0 THEN {title(tokens('genus') + '[1]')} ELSE '' END"


def _binomial(t: str, raw: str, lower_second: bool = False) -> str:
    extra = ""
    if lower_second:
        ch = f"substr(string_split({raw}, ' ')[2], 1, 1)"
        extra = f" AND {ch} = lower({ch}) AND {ch} <> upper({ch})"
    return (f"len({t}) >= 2 AND len(string_split({raw}, ' ')) >= 2 AND lower({t}[2]) NOT IN ({NON_SPECIES}) "
            f"AND (hint = '' OR lower({t}[1]) = lower(hint)){extra}")


def _epithet(t: str) -> str:
    return f"len({t}) = 1 AND hint <> '' AND lower({t}[1]) NOT IN ({NON_SPECIES})"


_SPECIES_CASES = [
    (_binomial("rt", "rx"), f"{title('rt[1]')} || ' ' || lower(rt[2])", "raw_species_binomial"),
    (_epithet("rt"), "hint || ' ' || lower(rt[1])", "raw_species_epithet"),
    (_binomial("st", "sx"), f"{title('st[1]')} || ' ' || lower(st[2])", "species_field_binomial"),
    (_epithet("st"), "hint || ' ' || lower(st[1])", "species_field_epithet"),
    (_binomial("nt_", "nx", True), f"{title('nt_[1]')} || ' ' || lower(nt_[2])", "scientific_name_binomial"),
]

# CTE ``labelled``: raw rows with canonical species and provenance.
LABELLED = f"""labelled AS MATERIALIZED (
  SELECT * EXCLUDE (rt, st, nt_, rx, sx, nx),
    CASE {' '.join(f'WHEN {c} THEN {v}' for c, v, _ in _SPECIES_CASES)} ELSE '' END AS canonical,
    CASE {' '.join(f"WHEN {c} THEN '{s}'" for c, _, s in _SPECIES_CASES)} ELSE 'missing_species' END AS provenance
  FROM (SELECT *, {tokens('raw_species')} AS rt, {tokens('species')} AS st, {tokens('scientific_name')} AS nt_,
          {nt('raw_species')} AS rx, {nt('species')} AS sx, {nt('scientific_name')} AS nx, {_HINT} AS hint
        FROM {{raw_manifest}}) t)"""

# CTEs ending in ``judged``: every raw row with its reject reason (null = accepted).
JUDGED = f"""{LABELLED}, claimed AS (
  SELECT *, {nt('image_url')} AS url, {finite('latitude')} AS lat, {finite('longitude')} AS lon,
    row_number() OVER (PARTITION BY {nt('image_url')} ORDER BY row_idx) AS claim_no,
    CASE WHEN {nt('record_id')} = '' THEN 1
         ELSE count(*) OVER (PARTITION BY {nt('source')}, {nt('record_id')}) END AS images
  FROM labelled), judged AS MATERIALIZED (
  SELECT *, {region('lat', 'lon')} AS region,
    CASE WHEN url = '' THEN 'missing_image_url' WHEN claim_no > 1 THEN 'duplicate_image_url'
         WHEN {nt('family')} <> '' AND lower({nt('family')}) <> 'nymphalidae' THEN 'non_nymphalidae_family'
         WHEN lat IS NULL OR lon IS NULL THEN 'missing_coordinate'
         WHEN {region('lat', 'lon')} = '' AND {country('country')} = 'United States'
              AND lower({state('state_province')}) IN ({STATES}) THEN 'us_metadata_but_out_of_bounds'
         WHEN {region('lat', 'lon')} = '' THEN 'non_us_coordinate'
         WHEN canonical = '' THEN 'missing_species_label' END AS reason
  FROM claimed)"""

CLEANED = f"""{JUDGED}, cleaned AS MATERIALIZED (
  SELECT row_idx, {nt('source')} AS source, {nt('record_id')} AS record_id, {nt('media_id')} AS media_id,
    {nt('source')} || ':' || {nt('record_id')} AS specimen_key, CAST(images AS BIGINT) AS record_image_count,
    'Nymphalidae' AS family, CASE WHEN hint <> '' THEN hint ELSE split_part(canonical, ' ', 1) END AS genus,
    canonical AS species, provenance AS species_source, {nt('scientific_name')} AS scientific_name,
    lat AS latitude, lon AS longitude, true AS has_coordinates, region AS us_region, {country('country')} AS country,
    {state('state_province')} AS state_province, {nt('event_date')} AS event_date,
    regexp_extract({nt('event_date')}, '(\\d{{{{4}}}})-(\\d{{{{2}}}})', 2) AS month, {nt('license')} AS license, url AS image_url,
    {nt('image_format')} AS image_format, {nt('download_status')} AS download_status, {nt('raw_species')} AS raw_species
  FROM judged WHERE reason IS NULL)""".replace("{{4}}", "{4}").replace("{{2}}", "{2}")
