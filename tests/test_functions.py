"""Column functions on hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from specimen_spark.functions import geo, media, numbers, quality, species, text
from specimen_spark.operators import split


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_whitespace(spark):
    values = [None, "", "  a  b ", "a b", "a\x1cb", "　a\tb\n"]
    assert column(spark, values, text.normalize_text) == ["", "", "a b", "a b", "a b", "a b"]


def test_ascii_fold(spark):
    values = ["é", "ñ", "ß", "æ", "ﬁn", "½", "Łódź", "plain", "a é"]
    assert column(spark, values, text.ascii_text) == ["e", "n", "", "", "fin", "12", "odz", "plain", "a e"]


def test_numbers(spark):
    values = [" 1.5 ", "1e3", "1.0d", "nan", "inf", "", None, "1_0", "-.5", "x"]
    assert column(spark, values, numbers.parse_float_finite) == [1.5, 1000.0, None, None, None, None, None, 10.0, -0.5, None]
    loose = column(spark, values, numbers.parse_float_any)
    assert math.isnan(loose[3]) and loose[4] == math.inf
    assert column(spark, ["6.0", "+7", " 8 ", "", "1_0"], lambda c: numbers.parse_int(c, -1)) == [-1, 7, 8, -1, 10]


def test_geopoints(spark):
    values = ["24.5,-80", "-80.1 24.5", "-100.1 24.5", "200,300", "12", None]
    got = column(spark, values, geo.parse_geopoint_text)
    assert [tuple(p) if p else None for p in got] == [(24.5, -80.0), (-80.1, 24.5), (24.5, -100.1), None, None, None]
    assert column(spark, [[-80.0, 24.0], [1.0]], geo.parse_geopoint_array, "array<double>")[0]["lat"] == 24.0


def test_view_hints(spark):
    values = ["x_dorsal.jpg", "under-side", "upper_side", "underside", "a%20dorsal", "a+top", "%zz ventral", "dorsal ventral",
              "img_d_1", "img_v", "seaside", "profile", "", None]
    got = [tuple(r) for r in column(spark, values, media.infer_view_hint)]
    unknown, ambiguous = ("unknown", "none"), ("unknown", "metadata_ambiguous")
    assert got == [("dorsal", "metadata"), ambiguous, ambiguous, ("ventral", "metadata"), ("dorsal", "metadata"),
                   ("dorsal", "metadata"), ("ventral", "metadata"), ambiguous, ("dorsal", "metadata"), ("ventral", "metadata"),
                   unknown, ("lateral", "metadata"), unknown, unknown]


def test_licences_match_restricted_ones_too(spark):
    values = ["CC-BY-NC", "http://creativecommons.org/licenses/by-nd/4.0", "all rights", None]
    assert column(spark, values, media.license_allowed) == [True, True, False, False]


def test_extensions(spark):
    values = ["http://h/a.JPG?x=1", "http://h/a.tiff#f", "http://h/.jpg", "http://h/a", "a b.png", "http://h.png"]
    assert column(spark, values, text.guess_extension) == [".jpg", ".tiff", ".jpg", ".jpg", ".png", ".jpg"]
    assert column(spark, values, lambda c: text.guess_extension(F.lit("u"), F.lit("image/png; q=1")))[0] == ".png"


def test_blank_record_keeps_a_key(spark):
    assert column(spark, [""], lambda c: species.specimen_key(F.lit("gbif"), c)) == ["gbif:"]


def test_dateline_longitude_clamps(spark):
    assert column(spark, [175.0], lambda c: geo.normalize_latlon(F.lit(52.0), c), "double")[0]["lon_norm"] == 1.0


def test_rounding_is_half_even(spark):
    got = column(spark, [5], lambda c: quality.expand_bbox(F.lit(10), F.lit(10), F.lit(10) + c, F.lit(10) + c, F.lit(99), F.lit(99), 0.5), "int")[0]
    assert (got["left"], got["right"]) == (8, 17)


# Worked out by hand: (groups, val share, test share) -> train, val, test.
SIZES = {
    (0, 0.1, 0.1): (0, 0, 0), (1, 0.1, 0.1): (1, 0, 0), (2, 0.1, 0.1): (1, 1, 0), (3, 0.1, 0.1): (1, 1, 1), (4, 0.1, 0.1): (2, 1, 1),
    (10, 0.1, 0.1): (8, 1, 1), (25, 0.1, 0.1): (21, 2, 2), (35, 0.1, 0.1): (27, 4, 4), (101, 0.1, 0.1): (81, 10, 10),
    (4, 0.4, 0.5): (1, 2, 1), (5, 0.4, 0.5): (1, 2, 2), (6, 0.4, 0.5): (1, 2, 3), (10, 0.4, 0.5): (1, 4, 5),
    (4, 0.5, 0.5): (1, 2, 1), (5, 0.5, 0.5): (1, 2, 2), (7, 0.5, 0.5): (1, 4, 2), (10, 0.5, 0.5): (1, 5, 4),
}


def test_split_sizes(spark):
    for (n, val, test), want in SIZES.items():
        assert tuple(column(spark, [n], lambda c: split.split_sizes(c, val, test), "int")[0]) == want, (n, val, test)


def test_split_sizes_always_add_up(spark):
    for val, test in ((0.1, 0.1), (0.3, 0.6), (0.6, 0.3), (0.45, 0.45), (0.0, 0.99), (0.5, 0.5), (0.3, 0.7), (0.95, 0.05), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0)):
        for n, got in enumerate(column(spark, list(range(60)), lambda c: split.split_sizes(c, val, test), "int")):
            assert sum(got) == n and min(got) >= 0 and (n == 0 or got["train"] >= 1)
    for val, test in ((0.9, 0.9), (0.51, 0.5), (-0.1, 0.2), (1.0, 0.1)):
        with pytest.raises(ValueError, match="shares"):
            split.split_sizes(F.lit(4), val, test)


def test_partition_counts(spark):
    def counts(n, weights):
        df = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(split.partition_counts(F.lit(n).cast("bigint"), weights))])
        return list(df.first())

    assert counts(10, [1, 1, 1]) == [3, 3, 4]
    assert counts(7, [1, 2, 1]) == [2, 3, 2]
