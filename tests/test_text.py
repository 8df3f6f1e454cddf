"""Text, array and number functions on literals."""

import pytest
from pyspark.sql import functions as F

from quillstone.functions import arrays, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, key", [("mrs_wilma_tarn", "wilma tarn"), ("Rev. Otto Quill", "otto quill"), ("Lady D'Arbo-Penn", "darbo penn"), ("Prof  Dr A  B", "a b"), ("", "")])
def test_name_key(spark, raw, key):
    assert one(spark, text.name_key(F.lit(raw))) == key


@pytest.mark.parametrize("raw, number", [("0070315", "70315"), ("No. 98-1 44", "98144"), ("000", "0"), ("none", None), (None, None)])
def test_registration_number(spark, raw, number):
    assert one(spark, text.registration_number(F.lit(raw).cast("string"))) == number


@pytest.mark.parametrize("x, digits, expected", [(-2.25, 1, -2.2), (2.25, 1, 2.3), (0.5, 0, 1.0), (-0.5, 0, 0.0)])
def test_half_up(spark, x, digits, expected):
    assert one(spark, numbers.half_up(F.lit(x), digits)) == expected


def test_sections_and_lists(spark):
    assert one(spark, text.section_key(F.lit("Treatments & Tests!"))) == "treatments_and_tests"
    assert one(spark, text.delimited(F.lit("a; b ,, <b>c</b>"))) == ["a", "b", "c"]
    assert one(spark, text.normalise(F.lit(" <p> a  b</p> "))) == "a b"
    assert one(spark, text.normalise(F.lit("<p> </p>"))) is None


@pytest.mark.parametrize("heading, tag, category", [("Overview", "h2", "OVERVIEW"), ("Overview", "button", None), ("Book online now", "h3", "CTA_EXCLUDE"), ("Practising since: 2004", "h2", "PRACTISING_SINCE"), ("Treatments and tests offered", "h3", "TREATMENTS"), ("Odd", "h2", None), ("MEMBERSHIPS", "h2", "MEMBERSHIPS")])
def test_heading_category(spark, heading, tag, category):
    assert one(spark, text.heading_category(F.lit(heading), F.lit(tag))) == category


def test_small_extracts(spark):
    assert one(spark, text.first_year(F.lit("since 2004"))) == 2004
    assert one(spark, text.first_year(F.lit("since 1850"))) is None
    assert one(spark, text.phone(F.lit("(020) 7946-0958"))) == "02079460958"
    assert one(spark, text.phone(F.lit("0812 345 6789"))) is None
    assert one(spark, text.phones(F.lit("call 01632 960001 or 07700 900123, 01632 960001"))) == ["01632960001", "07700900123"]
    assert one(spark, text.superlatives(F.lit("The best, no. 1 and world-class; bestow"))) == ["best", "world-class", "no. 1"]
    assert one(spark, text.declares_something(F.lit("He has no interests to declare."))) is False
    assert one(spark, text.declares_something(F.lit("Owns shares in a clinic"))) is True
    assert one(spark, text.csv_field(F.lit('a "b",c'))) == '"a ""b"",c"'
    assert one(spark, text.host_blocked(F.lit("https://www.x.com/a"), ["x.com"])) is True
    assert one(spark, text.host_blocked(F.lit("https://notx.com/a"), ["x.com"])) is False
    assert one(spark, text.without_artefacts(F.lit("Browser does not support frames"))) is None


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Treats ages 3 to 16", ("ages 3 to 16", 3, 16)), ("from the ages of 5-12 only", ("from the ages of 5-12", 5, 12)), ("over the age of 18", ("over the age of 18", 18, None)), ("Above age 21", ("Above age 21", 21, None)),
        ("ages 30 to 4", None), ("ages 9 to 130", None), ("over the age of 121", None), ("call 01632 96", None), ("aged well", None), (None, None),
    ],
)
def test_age_limit(spark, line, expected):
    got = one(spark, text.age_limit(F.lit(line).cast("string")))
    assert (got and tuple(got)) == expected


def test_age_restriction(spark):
    pick = lambda body, *lines: one(spark, text.age_restriction(F.lit(body), F.array(*map(F.lit, lines)).cast("array<string>")))
    assert tuple(pick("He only sees adult patients", "ages 3 to 9")) == ("ages 3 to 9", 3, 9)
    assert tuple(pick("She only see adults", "ages 3 to 9")) == ("only see adults", 18, None)
    assert tuple(pick("", "ages 30 to 4", "the age is ages 4 to 30", "ages 5 to 6")) == ("ages 4 to 30", 4, 30) and pick("nothing") is None


def test_patterns(spark):
    for line, broken in (("s****ees adults", True), ("a **bold** word", True), ("a * b ** c", False), ("2*3", False), ("x_000D_ {{y}}", False)):
        assert one(spark, text.broken_words(F.lit(line))) is broken
    for line, code, booked in (("gmc  number: 70315, of", "70315", "70315"), ("GMC number:AB-12.", "AB-12", None), ("number 5", None, None)):
        assert one(spark, text.registration_code(F.lit(line))) == code and one(spark, text.booking_code(text.registration_code(F.lit(line)))) == booked
    for line, year in (("in 1949 or 2001", 1949), ("12011 then 1987", 1987), ("from 1850", None), ("x1999", None)):
        assert one(spark, text.whole_year(F.lit(line))) == year


def test_numbers_side_by_side(spark):
    """Each line's numbers, told apart by the groups in which they are written."""
    lines = {
        "0121 496 0123 07700 900123": ["01214960123", "07700900123"], "01214960123 07700900123": ["01214960123", "07700900123"], "0121 496 0123 12 to 14 Main St": ["01214960123"], "020\u00a07946\u00a00123,07700900123": ["02079460123", "07700900123"],
        "0300 123 4567 0300 123 4567": ["03001234567"], "0800 123 4567, 0121 49": [], "9 0121 496 012": ["0121496012"], "": [],
    }
    for line, found in lines.items():
        assert one(spark, text.phones(F.lit(line))) == found, line
    for line, found in {"write to a@b.org.": ["a@b.org"], "a-b@c-d.org, A+1@x.y.z; a-b@c-d.org": ["a-b@c-d.org", "A+1@x.y.z"], "a@b @c.d e@-.": []}.items():
        assert one(spark, text.emails(F.lit(line))) == found, line


def test_facts(spark):
    words = lambda s: text.fact_words(F.lit(s))
    assert one(spark, words("The Knee, and the KNEE-joint surgery!")) == ["knee", "joint", "surgery"]
    assert one(spark, text.jaccard(words("knee surgery london"), words("knee surgery leeds"))) == 0.5
    assert one(spark, text.jaccard(words("the"), words("knee"))) == 0.0


def test_arrays(spark):
    a = F.array(F.lit("A"), F.lit("b"), F.lit("a"))
    assert one(spark, arrays.distinct_ci(a)) == ["A", "b"]
    assert one(spark, arrays.merged_ci(F.array(F.lit("A")), F.array(F.lit("a"), F.lit("c"), F.lit("c")))) == ["A", "c", "c"]
    assert one(spark, arrays.missing(F.lit(None).cast("array<string>"))) is True
    assert one(spark, arrays.has(F.lit(None).cast("array<string>"), lambda x: x == "a")) is False
    assert one(spark, arrays.overlaps_ci(a, ["B"])) is True


def test_model_answers(spark):
    from quillstone.operators import desk

    assert one(spark, desk.answer_list(F.lit('```json\n["a", "b"]\n```'))) == ["a", "b"]
    assert one(spark, desk.answer_list(F.lit("- a\n- b; c"))) == ["a", "b", "c"]
    assert one(spark, desk.answer_list(F.lit("null"))) is None and one(spark, desk.answer_text(F.lit(" NULL "))) is None
    assert one(spark, desk.answer_year(F.lit("```\nno. 32011, since 1938\n```"))) == 1938
    good = '{"plain_english_score": 4, "bio_depth": "thin", "treatment_specificity": "generic", "qualifications_completeness": "minimal", "languages": ["fr"]}'
    assert one(spark, desk.assessment(F.lit(good))).languages == ["fr"]
    for bad in (good.replace("4", "6"), good.replace("thin", "odd"), "no json"):
        assert one(spark, desk.assessment(F.lit(bad))) is None
    images = spark.createDataFrame([("s", f"u{i}", i, 2) for i in range(5)] + [("s", "x", None, None)], "slug string, url string, width int, height int")
    assert [r.url for r in desk.largest_images(images).orderBy("rank").collect()] == ["u4", "u3", "u2"]
    assert desk.shuffled(images, 3).count() == 3
    assert tuple(spark.range(1).select(*desk.bar(F.lit(0), F.lit(0))).first()) == (0.0, 0.0)
    assert one(spark, desk.queries_for(F.lit("A B"), F.lit("Leeds"), F.lit("Knees"))) == ['"A B" Knees consultant', '"A B" Leeds', '"A B" Knees portrait photo']
    assert one(spark, desk.queries_for(F.lit("A B"), F.lit(None).cast("string"), F.lit("Knees")))[1] == '"A B" Knees hospital'
    assert one(spark, text.plain(F.lit("# Head\n- **a** [b](c)"))) == "Head\na b"
    assert one(spark, text.registration_label(F.lit("HCPC 012"))) == "HCPC-12"
    m = F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2))
    assert one(spark, arrays.keys_outside(m, ["a"])) == ["b"]
