"""Species labels: canonical binomials with provenance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specimen_spark.fixed_values import NON_SPECIES_WORDS
from specimen_spark.functions.text import (
    alpha_tokens, as_column, let, normalize_text, second_word, title_token, tokenize_alpha,
)


def _starts_lower(token: Column) -> Column:
    first = F.substring(token, 1, 1)
    return (first == F.lower(first)) & (first != F.upper(first))


def genus_hint(genus) -> Column:
    """Title-cased first alphabetic token, blank when there is none."""
    return let(F.coalesce(F.get(tokenize_alpha(genus), F.lit(0)), F.lit("")), title_token)


def _qualifies(tokens: Column, text: Column, hint: Column) -> Column:
    """The text reads as a binomial that agrees with the genus hint."""
    return (
        (F.size(tokens) >= 2)
        & text.contains(" ")
        & ~F.lower(F.get(tokens, F.lit(1))).isin(*NON_SPECIES_WORDS)
        & ((hint == "") | (F.lower(F.get(tokens, F.lit(0))) == F.lower(hint)))
    )


def _cases(p) -> list[tuple[Column, Column, str]]:
    """``(condition, species, source)`` in order, from ``hint`` and the text and tokens of the name columns."""
    hint, cases = p["hint"], []

    def pair(tokens: Column) -> Column:
        return F.concat_ws(" ", title_token(F.get(tokens, F.lit(0))), F.lower(F.get(tokens, F.lit(1))))

    for part, source in (("raw", "raw_species"), ("field", "species_field")):
        tokens, text = p[f"{part}_tokens"], p[part]
        only = F.lower(F.get(tokens, F.lit(0)))
        single = (F.size(tokens) == 1) & (hint != "") & ~only.isin(*NON_SPECIES_WORDS)
        cases.append((_qualifies(tokens, text, hint), pair(tokens), f"{source}_binomial"))
        cases.append((single, F.concat_ws(" ", hint, only), f"{source}_epithet"))
    # A scientific name only counts when its second word starts in lower case.
    tokens, text = p["name_tokens"], p["name"]
    second_lower = _starts_lower(second_word(text))
    cases.append((_qualifies(tokens, text, hint) & second_lower, pair(tokens), "scientific_name_binomial"))
    return cases


def _label(p) -> Column:
    chosen = F
    for condition, species, source in _cases(p):
        chosen = chosen.when(condition, F.struct(species.alias("species"), F.lit(source).alias("source")))
    return chosen.otherwise(F.struct(F.lit("").alias("species"), F.lit("missing_species").alias("source")))


def canonical_species(raw_species, species, scientific_name, genus) -> Column:
    """``struct<species, source>``; blank species with source ``missing_species`` when nothing fits."""
    texts = {"raw": raw_species, "field": species, "name": scientific_name}
    parts = F.struct(
        genus_hint(genus).alias("hint"),
        *[normalize_text(c).alias(n) for n, c in texts.items()],
        *[tokenize_alpha(c).alias(f"{n}_tokens") for n, c in texts.items()],
    )
    return let(parts, _label)


def with_species_label(df, raw_species, species, scientific_name, genus, prefix: str = "__"):
    """``canonical_species`` as columns ``species_label``, ``species_source`` and ``genus_hint``.

    Same result as the column function. Texts, tokens and the number of the
    matching case become columns of their own, so each is computed once.
    """
    texts = {"raw": raw_species, "field": species, "name": scientific_name, "genus": genus}
    rows = df.select("*", *[normalize_text(c).alias(f"__t_{n}") for n, c in texts.items()])
    rows = rows.select("*", *[alpha_tokens(F.col(f"__t_{n}")).alias(f"__t_{n}_tokens") for n in texts])
    hint = f"{prefix}genus_hint"
    rows = rows.withColumn(hint, title_token(F.coalesce(F.get(F.col("__t_genus_tokens"), F.lit(0)), F.lit(""))))
    cases = _cases({"hint": F.col(hint), **{
        n: F.col(f"__t_{n}") for t in ("raw", "field", "name") for n in (t, f"{t}_tokens")}})
    which, label, source = F, F, F
    for i, (condition, value, name) in enumerate(cases):
        which = which.when(condition, F.lit(i))
        label = label.when(F.col("__t_case") == i, value)
        source = source.when(F.col("__t_case") == i, F.lit(name))
    return rows.withColumn("__t_case", which.otherwise(F.lit(-1))).select(
        *df.columns, hint, label.otherwise(F.lit("")).alias(f"{prefix}species_label"),
        source.otherwise(F.lit("missing_species")).alias(f"{prefix}species_source"))


def ingest_binomial(scientific_name, genus, species) -> Column:
    """Binomial at ingest time, null when the record is not at species level.

    Candidates in order: the species text when it has two words, else genus
    plus species text; then the scientific name.
    """

    def candidate(text: Column, *, genus_text: Column | None = None, lower_second: bool = False) -> Column:
        second = second_word(text)
        words = F.struct(
            F.regexp_replace(F.substring_index(text, " ", 1), r"[^A-Za-z-]", "").alias("genus"),
            F.lower(F.regexp_replace(second, r"[^A-Za-z-]", "")).alias("epithet"),
        )

        def judge(w: Column) -> Column:
            ok = (w["genus"] != "") & (w["epithet"] != "") & ~w["epithet"].isin(*NON_SPECIES_WORDS)
            if genus_text is not None:
                ok = ok & ((genus_text == "") | (F.lower(w["genus"]) == F.lower(genus_text)))
            if lower_second:
                ok = ok & _starts_lower(second)
            return F.when(ok, F.concat_ws(" ", title_token(w["genus"]), w["epithet"]))

        return let(words, judge)

    def choose(p: Column) -> Column:
        two_words = p["species"].contains(" ")
        joined = (p["genus"] != "") & (p["species"] != "") & ~two_words
        return F.coalesce(
            F.when(two_words, candidate(p["species"], genus_text=p["genus"])),
            F.when(joined, candidate(F.concat_ws(" ", p["genus"], p["species"]))),
            candidate(p["name"], lower_second=True),
        )

    return let(F.struct(
        normalize_text(genus).alias("genus"), normalize_text(species).alias("species"),
        normalize_text(scientific_name).alias("name"),
    ), choose)


def is_species_level(scientific_name, genus, species) -> Column:
    return ingest_binomial(scientific_name, genus, species).isNotNull()


def specimen_key(source, record_id) -> Column:
    """``source:record``; a blank record still gives the non-blank key ``source:``."""
    return F.concat(normalize_text(source), F.lit(":"), normalize_text(record_id))


def group_key(*columns) -> Column:
    """First non-blank of specimen, record, URL and path columns; blank when all are."""
    normalised = [F.nullif(normalize_text(c), F.lit("")) for c in columns]
    return F.coalesce(*normalised, F.lit(""))


def frequency_band(count) -> Column:
    from specimen_spark.fixed_values import FREQUENCY_BANDS

    value = as_column(count)
    band = F.lit(FREQUENCY_BANDS[-1][0])
    for name, upper in reversed(FREQUENCY_BANDS[:-1]):
        band = F.when(value < upper, F.lit(name)).otherwise(band)
    return band
