import re
import sys
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import pytest
from conftest import values
from pyspark.sql import functions as F

from trendgap.config import POSITIVE_WORDS, BrandConfig
from trendgap.functions import text
from trendgap.functions import values as numbers


def one(spark, column, **inputs):
    """Evaluate an expression over one row of inputs."""
    fields = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in inputs.items())
    frame = spark.createDataFrame([tuple(inputs.values())], fields or "x int")
    return frame.select(column.alias("out")).first()["out"]


def test_white_space_is_what_python_strips():
    blanks = {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}
    assert set(text.WHITESPACE) == blanks


def test_strip(spark):
    assert one(spark, text.strip(F.col("a")), a="　\n a b \x1f\xa0") == "a b"


@pytest.mark.parametrize(
    "caption",
    [
        "see #one and #two_2, not # three",
        "##double #Café#next #naïve-tail",
        "#स्किन #日本語 #١٢٣ #½",
        "#emoji😀 #a.b #_x",
        "none here",
        "",
    ],
)
def test_tags_in_text_are_those_python_finds(spark, caption):
    expected = [f"#{m}" for m in re.findall(r"#(\w+)", caption)]
    assert one(spark, text.extract_tags(F.col("c")), c=caption) == expected


def test_clean_tags(spark):
    given = ["##a", "a", "", None, "#", "b#c"]
    assert one(spark, text.clean_tags(F.col("t")), t=given) == ["#a", "#a", "#", "#b#c"]


@pytest.mark.parametrize(
    ("given", "distinct", "expected"),
    [
        (["a", "##a", "b"], True, ["#a", "#b"]),
        (["a", "##a", "b"], False, ["#a", "#a", "#b"]),
        # The raw list decides for stored posts, the cleaned one for feed posts.
        (["", None], True, []),
        (["", None], False, ["#x", "#x", "#y"]),
        ([], True, ["#x", "#y"]),
        (None, True, ["#x", "#y"]),
        (None, False, ["#x", "#x", "#y"]),
    ],
)
def test_choose_tags(spark, given, distinct, expected):
    frame = spark.createDataFrame([("#x #x #y", given)], "c string, t array<string>")
    chosen = text.choose_tags(F.col("c"), F.col("t"), distinct, 10)
    assert frame.select(chosen).first()[0] == expected


def test_choose_tags_cuts_after_removing_repeats(spark):
    frame = spark.createDataFrame([("", ["a", "a", "b", "c"])], "c string, t array<string>")
    assert frame.select(text.choose_tags(F.col("c"), F.col("t"), True, 2)).first()[0] == ["#a", "#b"]
    assert frame.select(text.choose_tags(F.col("c"), F.col("t"), False, 2)).first()[0] == ["#a", "#a"]


def test_form_tags(spark):
    typed = [" #one ", "one", "##two", "", "#"]
    assert one(spark, text.config_tags(F.col("t")), t=typed) == ["#one", "##two"]
    assert one(spark, text.search_tags(F.col("t")), t=["#one", "##two"]) == ["one", "two"]
    assert one(spark, text.competitor_names(F.col("t")), t=["#A", "B#C#", "D"]) == ["A", "BC#", "D"]


BRAND = BrandConfig("Plum", competitors=("Rose", "Rosehip"))


@pytest.mark.parametrize(
    ("caption", "user", "expected"),
    [
        ("PLUMP lips", "", "Plum"),  # a substring is enough
        ("plum and rose", "", "Rose"),  # competitors first
        ("rosehip oil", "", "Rose"),  # first in the list, not the longest
        ("nothing", "the_rosehip", "Rose"),
        ("nothing", None, "Unknown"),
        (None, None, "Unknown"),
    ],
)
def test_detect_brand(spark, caption, user, expected):
    found = text.first_brand(BRAND, text.lowered(F.col("c"), F.col("u")))
    assert one(spark, found, c=caption, u=user) == expected


@pytest.mark.parametrize(
    ("caption", "expected"),
    [
        ("naturally pure", 0.2),
        ("Pure pure PURE", 0.1),
        (" ".join(POSITIVE_WORDS), 1.0),
        ("bad", 0.0),
        ("", 0.0),
        (None, 0.0),
    ],
)
def test_sentiment(spark, caption, expected):
    score = text.sentiment(F.col("c"), POSITIVE_WORDS, 0.1, 1.0)
    assert one(spark, score, c=caption) == pytest.approx(expected, abs=1e-15)


def test_sentiment_is_capped(spark):
    words = [f"w{i}x" for i in range(12)]
    assert one(spark, text.sentiment(F.col("c"), words, 0.1, 1.0), c=" ".join(words)) == 1.0


def unfenced(content):
    content = content.strip()
    if content.startswith("```"):
        content = content.split("```")[1]
        content = content.removeprefix("json").strip()
    return content


@pytest.mark.parametrize(
    "content",
    [
        "[1]", " [1]\n", "```\n[1]\n```", "```json\n[1]\n``` more", "```json[1]", "```",
        "x ```json\n[1]```", "```jsonjson```", "``````",
    ],
)
def test_strip_fences(spark, content):
    assert one(spark, text.strip_fences(F.col("c")), c=content) == unfenced(content)


@pytest.mark.parametrize(
    ("written", "expected"),
    [
        ("2024-03-01T10:20:30Z", datetime(2024, 3, 1, 10, 20, 30)),
        ("2024-03-01T10:20:30+05:30", datetime(2024, 3, 1, 10, 20, 30)),
        ("2024-03-01T10:20:30.125-0800", datetime(2024, 3, 1, 10, 20, 30, 125000)),
        ("2024-03-01 10:20", datetime(2024, 3, 1, 10, 20)),
        ("2024-03-01T10", datetime(2024, 3, 1, 10)),
        ("2024-03-01", datetime(2024, 3, 1)),
        ("2024", None),
        ("2024-3-1", None),
        ("2024-02-30", None),
        ("1709288430", None),
        ("yesterday", None),
        ("", None),
        (None, None),
    ],
)
def test_times_keep_their_clock_and_lose_their_offset(spark, written, expected):
    default = F.lit("2000-01-01 00:00:00").cast("timestamp")
    got = one(spark, numbers.iso_to_utc(F.col("t"), default).cast("timestamp_ntz"), t=written)
    assert got == (expected or datetime(2000, 1, 1))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    frame = spark.createDataFrame([("2024-03-10T02:30:00+01:00",)], "t string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        seconds = F.unix_timestamp(numbers.iso_to_utc(F.col("t"), F.lit(None).cast("timestamp")))
        assert frame.select(seconds).first()[0] == 1710037800
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_counts_fall_through_zero(spark):
    got = numbers.first_count(F.col("a"), F.col("b"))
    cases = {("5", "9"): 5, ("0", "9"): 9, (None, "9"): 9, ("x", "9"): 9, ("12.7", None): 12, (None, None): 0}
    for (a, b), expected in cases.items():
        assert one(spark, got, a=a, b=b) == expected


def test_estimated_shares(spark):
    frame = spark.createDataFrame([(n,) for n in (0, 19, 20, 39, 50000, -100)], "n bigint")
    assert values(frame.select(numbers.estimated_shares(F.col("n"), 0.05))) == [
        (max(int(n * 0.05), 0),) for n in (0, 19, 20, 39, 50000, -100)
    ]


def test_compact_numbers_round_the_exact_value_half_up(spark):
    def shown(n):
        if n < 1000:
            return str(n)
        exact = Decimal(n / 1000)
        return f"{exact.quantize(Decimal('0.1'), ROUND_HALF_UP)}K"

    numbers_tried = [*range(0, 12_000), 999_949, 999_950, 1_234_567, 20_250, 20_750]
    frame = spark.createDataFrame([(n,) for n in numbers_tried], "n bigint")
    got = values(frame.select("n", numbers.compact_number(F.col("n"))))
    assert got == [(n, shown(n)) for n in numbers_tried]


def test_score_tiers(spark):
    frame = spark.createDataFrame([(s,) for s in (90, 89, 80, 79, None)], "s int")
    assert [r[0] for r in frame.select(numbers.score_tier(F.col("s"))).collect()] == [
        "high", "mid", "mid", "low", "low",
    ]


def test_prompt_pieces(spark):
    brand = BrandConfig("Acme Co", tone="Bold")
    plain = one(spark, text.video_prompt(F.col("p")), p="A cup")
    branded = one(spark, text.video_prompt(F.col("p"), brand), p=None)
    assert plain.startswith("A cup. Vertical 9:16")
    assert branded.startswith(". Brand: Acme Co. Tone: Bold. Vertical")
    assert one(spark, text.reel_file_name(F.col("b")), b="Acme Co") == "acme_co_reel.mp4"
    assert one(spark, text.post_text(F.col("c"), F.col("t")), c="Hi", t=["#a", "#b"]) == "Hi\n\n#a #b"


@pytest.mark.parametrize(
    "text, clock",
    [
        ("2024-01-02T03:04:05.123456789Z", "2024-01-02 03:04:05.123456"),
        ("2024-01-02T03:04:05,5+01:00", "2024-01-02 03:04:05.500000"),
        ("20240102T030405Z", "2024-01-02 03:04:05"),
        ("20240102T0304", "2024-01-02 03:04:00"),
        ("20240102", "2024-01-02 00:00:00"),
        ("2024-01-02T030405.25-0800", "2024-01-02 03:04:05.250000"),
        ("2024-01-02T03:04:05" + "x" * 80, None),
        ("202401", None),
    ],
)
def test_further_forms_of_time(spark, text, clock):
    frame = spark.createDataFrame([(text,)], "t string")
    got = frame.select(numbers.iso_to_utc(F.col("t"), F.lit(None).cast("timestamp")).cast("timestamp_ntz")).first()[0]
    assert (None if got is None else str(got)) == clock
