"""Readers, writers, snapshots, matching and streams on small fixtures."""

import gzip
import random

from pyspark.sql import functions as F

from quillstone.operators import compare, corroboration, desk, filters, matching, metrics, scoring
from quillstone.plans import tools
from quillstone.sources import html, sinks, sitemaps, snapshots
from quillstone.streaming.ingest import ingest_pages, windowed_counts

PAGE = """<html><head><meta class="swiftype" name="fullname" content="Dr Meta"></head><body><div id="ccc"><h1>Cookies</h1></div>
<h1 itemprop="name">Professor  Ann Lee</h1><p>GMC number: 1234567, since then</p><aside class="consultant__image"><img src="/p.jpg"></aside><iframe src="https://x/booking"></iframe>
<div class="x-booking-box"><p>Note on booking: new patients.</p></div>
<h2>Overview</h2><p>In short.</p><h2>About</h2><p>She treats knees. Browser does not support frames</p><h3>Odd</h3><p>and hips</p>
<h2>Specialties</h2><h3>Knee</h3><p>Sub-specialties: Hip, Spine</p><h2>Treatments and tests offered</h2><ul><li>Scan,</li><li>scan</li><li>Biopsy</li></ul>
<h2>Practising since: 2004</h2><h2>Locations</h2><div><h3>Acme Health at Leeds Hospital</h3><a href="/hospitals/leeds">see</a></div><h2>Declaration</h2><p>No interests to declare</p>
<h2>Related experience</h2><p>Led a unit.</p><h2>Special interests</h2><ul><li>Cartilage</li></ul><h2>Other interests</h2><ul><li>Gait</li><li>cartilage</li></ul><h2>Personal interests</h2><p>Rowing</p><h2>Professional roles</h2><p>Chair</p>
<h2>In the news</h2><p><a href="https://n.example/1">Story</a></p><span itemprop="telephone">01632 960001</span><a href="mailto:a%40b.c?x=1">mail</a><a href="https://facebook.com/x">f</a><a href="https://own.example/">own</a>
<p>CQC rating: Good</p><div>All ages welcome <p>She s****ees</p></div><p>Sees ages 30 to 4 no more</p><p>Sees patients of ages 3 - 16</p></body></html>"""
BARE = "<h1>Dr Bo Ek</h1><h2>Special interests</h2><ul><li>Feet</li></ul><h2>Locations</h2><div><h3>Independent Clinic</h3></div><p>Online booking is for initial visits <b>x</b></p><p>He only sees adults over the age of 21</p>"


def test_parse(spark):
    r = html.parse(spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, BARE)], "page_id int, html string"), network="Acme Health").orderBy("page_id").collect()
    a = r[0]
    assert (a["name"], a.title, a.registration_number, a.booking_code, a.has_photo, a.booking_state) == ("Professor Ann Lee", "Professor", "1234567", "1234567", True, "bookable_no_slots")
    assert a.booking_caveat == "Note on booking: new patients." and a.overview_text == "In short." and a.related_experience_text == "Led a unit."
    assert a.about_text.startswith("She treats knees.") and "hips" in a.about_text and "frames" not in a.about_text
    assert a.specialty_sub == ["Knee", "Hip", "Spine"] and a.treatments == ["Scan", "Biopsy"] and a.practising_since == 2004
    assert (a.clinical_interests, a.personal_interests, a.professional_roles, a.treatments_excluded) == (["Cartilage", "Gait"], "Rowing", "Chair", [])
    assert (a.site, a.site_code, a.in_network, a.at_partner) == ("Acme Health at Leeds Hospital", "leeds", True, True)
    assert (a.phone, a.mobile, a.email, a.website, a.rating) == ("01632960001", None, "a@b.c", "https://n.example/1", "Good")
    assert (a.declaration, a.declaration_substantive, a.age_text, a.age_least, a.age_most, a.cms_corruption, a.low_confidence) == (["No interests to declare"], False, "ages 3 - 16", 3, 16, True, [])
    assert [(n.title, n.url) for n in a.news] == [("Story", "https://n.example/1")]
    assert len(a.confidence) == 25 and (a.confidence["name"], a.confidence["treatments"], a.confidence["languages"], a.confidence["has_photo"]) == ("high", "high", "medium", "high")
    assert r[1]["name"] is None and r[1].treatments == [] and r[1].bio_depth == "missing" and r[2].low_confidence == ["name", "registration_number"]
    b = r[3]
    assert (b.treatments, b.confidence["treatments"], b.in_network, b.at_partner, b.declaration, b.declaration_substantive) == (["Feet"], "medium", False, False, None, None)
    assert (b.age_text, b.age_least, b.booking_caveat, b.low_confidence) == ("only sees adults", 18, "Online booking is for initial visits", ["registration_number"])


def test_page_flags(spark):
    pages = html.parse(spark.createDataFrame([(1, PAGE), (4, BARE)], "page_id int, html string")).withColumn("plain_english_score", F.lit(4))
    got = scoring.scored(pages, extra=html.page_flags()).orderBy("page_id").collect()
    codes = [{f.code for f in r.flags} - set(list(scoring.FLAGS)[:8]) for r in got]
    assert codes == [{"CONTENT_CMS_CORRUPTION", "PROFILE_AGE_RESTRICTION"}, {"PROFILE_OUTSIDE_NETWORK", "PROFILE_AGE_RESTRICTION", "QA_LOW_CONFIDENCE"}]
    shown = spark.createDataFrame([(["x"], "t", ["a"], ["1"]), ([], None, ["a"], ["1"]), ([], "t", [], ["1"]), ([], "t", ["a"], None), ([], "t", ["a"], ["1"])], "u array<string>, a string, t array<string>, p array<string>")
    assert [r[0] for r in shown.select(html.anomalous(F.col("u"), F.col("a"), F.col("t"), F.col("p"))).collect()] == [True, True, True, True, False]


def test_cut_references_and_neighbouring_blocks(spark):
    """A heading cut within a reference keeps what is left of it where only whole ones are asked for, and asterisks at a block's end break no word of the next."""
    rows = [(1, "<title>Ann**</title><h1>Ann &amp;&quot;&amp</h1><p>Hips</p><a href='/x?a=1&copy=2'>x</a>"), (2, "<h1>Bea**</h1><p>Knees</p>"), (3, "<p>Kn**<b>e</b>es</p>")]
    pages = spark.createDataFrame(rows, "i int, html string")
    a, b, c = html.parse(pages).orderBy("i").collect()
    assert (a["name"], a.cms_corruption, b.cms_corruption, c.cms_corruption) == ('Ann &"&', False, False, True)
    assert html.parse(pages, references=("amp",)).orderBy("i").first()["name"] == "Ann &&quot;&amp"


def test_no_rivals_links_gather(spark):
    """Links are not dealt by rival alone, whether rivals are few or many."""
    links = spark.range(3000).selectExpr("id AS slug", "int(id % 7) AS rival_id", "'high' AS match_confidence", "timestamp'2024-01-01' AS matched_at")
    rivals = spark.createDataFrame([(2,), (3,), (3,), (None,)], "rival_id int")
    want = {i for i in range(3000) if i % 7 in (2, 3)}
    for out in (compare.linked_to(links, rivals), compare.linked_to(links, rivals, few=1, parts=8)):
        assert sorted(r.slug for r in out.collect()) == sorted(want)
    plan = compare.preferred_links(links, rivals)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_outlines_leave_the_worker_in_small_slices(spark):
    """However many pages a batch holds, few outlines are Python objects at a time, and a rival's page is parsed once."""
    assert html.slices([5, 5, 5, 99, 1, 1, 1, 1], 3, 10) == [(0, 2), (2, 3), (3, 4), (4, 7), (7, 8)] and html.slices([], 3, 10) == []
    pages = spark.range(1000).selectExpr("id", "if(id % 7 = 0, null, concat('<h1>P', id, '</h1>')) AS html").coalesce(1)
    got = html.outlined(pages, most_rows=16).selectExpr("id", "get(o.h1s, 0).text AS h").collect()
    assert {r.id: r.h for r in got} == {i: None if i % 7 == 0 else f"P{i}" for i in range(1000)}
    for out in (html.parse(pages), html.parse_rival(pages)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_sections_by_key(spark):
    page = "<h2>Main specialties</h2><ul><li>Knee; Hip</li><li>Hip</li></ul><h3>Main Specialties</h3><p>Spine</p>"
    out = html.sections_by_key(spark.createDataFrame([(1, page)], "id int, html string"))
    got = out.select("sections", html.section_list(F.col("sections"), "Other", "Main specialties").alias("l")).first()
    assert got.l == ["Knee", "Hip", "Spine"] and got.sections["main_specialties"].heading == "Main specialties"


def test_sitemaps(spark, tmp_path):
    with gzip.open(tmp_path / "s.xml.gz", "wt") as f:
        f.write("<loc> https://x/consultants/a-b </loc><loc>https://x/consultants/a-b</loc><loc>https://x/other</loc><loc>https://y/profile/12/ann-lee</loc><loc>https://y/profile/12/z</loc>")
    xml = sitemaps.read_xml(spark, str(tmp_path / "s.xml.gz"))
    assert [tuple(r) for r in sitemaps.profile_urls(xml, "https://x/consultants/").collect()] == [("https://x/consultants/a-b", "a-b")]
    assert [tuple(r) for r in sitemaps.rival_candidates(xml, r"/profile/(\d+)/([a-z-]+)").collect()] == [("12", "ann-lee", "https://y/profile/12/ann-lee", "ann lee")]
    (tmp_path / "ann.html").write_text("<p>\n</p>")
    assert [tuple(r) for r in sitemaps.cached_pages(spark, str(tmp_path / "*.html")).collect()] == [("ann", "<p>\n</p>")]


def test_booking(spark):
    slots = '{"response":{"responseData":{"bookingDetails":[{"slotId":"1","slotDate":"2026-03-03"},{"slotId":"2","slotDate":"2026-03-03"},{"slotId":"3","slotDate":"2026-03-04"}]}}}'
    answers = spark.createDataFrame([("p", slots), ("q", "bad"), ("r", None)], "practitioner_id string, body string")
    from quillstone.operators.metrics import slot_summary

    rows = sitemaps.booking_slots(answers).withColumn("price", F.lit("200"))
    got = slot_summary(rows, F.lit("2026-03-01").cast("date")).first()
    assert (got.slots_28_days, got.days_28_days, got.slots_a_day, str(got.next_slot), got.price) == (3, 2, 1.5, "2026-03-03", 200.0)
    prices = spark.createDataFrame([("p", '[{"price":"250"},{"price":200}]'), ("q", '{"price":"x"}'), ("r", '{"price":180}')], "practitioner_id string, body string")
    assert {r.practitioner_id: r.price for r in sitemaps.booking_prices(prices).collect()} == {"p": 200.0, "q": None, "r": 180.0}


def test_merge_sets_nulls_only_where_named(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "slug string, n int, t string")
    delta = spark.createDataFrame([("a", None, "z", ["n"]), ("c", 3, "w", [])], "slug string, n int, t string, changed array<string>")
    assert sorted(map(tuple, snapshots.merge(old, delta, ["slug"]).collect())) == [("a", None, "x"), ("b", 2, "y"), ("c", 3, "w")]


def test_runs(spark, tmp_path):
    runs = spark.createDataFrame([("a", "completed", 1), ("pilot-b", "completed", 3), ("c", "running", 4), ("d", "running", 5)], "run_id string, status string, started_at int")
    assert snapshots.latest_run(runs).first().run_id == "pilot-b" and filters.preferred_run(runs).first().run_id == "a" and snapshots.unfinished_run(runs).first().run_id == "d"
    assert [r.run_id for r in snapshots.run_history(runs, pilots=False).collect()] == ["d", "c", "a"]
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("r1", "s", 1), ("r2", "s", 2)], "run_id string, slug string, n int")
    snapshots.write_run(rows, path)
    snapshots.write_run(rows.where("run_id = 'r1'").withColumn("n", F.lit(9)), path)
    assert sorted((r.run_id, r.n) for r in spark.read.parquet(path).collect()) == [("r1", 9), ("r2", 2)]
    assert snapshots.exists(spark, path) and not snapshots.exists(spark, path + "x")
    assert snapshots.lookup(spark.read.parquet(path), run_id="r2", slug="s").count() == 1
    state = snapshots.status_counts(spark.createDataFrame([("completed",), ("failed",)], "status string")).first()
    assert (state.total, state.state) == (2, "finished_with_errors")
    known = spark.createDataFrame([("a", "complete"), ("b", "error"), ("c", "parse_done"), ("d", None)], "slug string, scrape_status string")
    assert {r.slug for r in snapshots.pending(known.select("slug"), known, "booking_done").collect()} == {"b", "c", "d"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", ["x"], "p", None)], "name string, tags array<string>, phone string, n int")
    assert sinks.csv_lines(df).first().line == '"a,b","[""x""]",' and sinks.csv_header(df) == "name,tags,n"
    assert sinks.csv_lines(df, {"n": "N", "phone": "Phone"}, contacts=True).first().line == ",p"
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().name == "a,b"


def test_matching(spark):
    home = spark.createDataFrame([("s1", "Dr Ida Brook"), ("s2", "Dr Ida Lou Brook"), ("s3", "Ms Una Marlowe"), ("s4", None), ("s5", "Bo Ek"), ("s6", "Cher")], "slug string, name string")
    rival = spark.createDataFrame([("1", "ida brook"), ("2", "ida louise brook"), ("3", "una marlowe"), ("4", "una marlowe"), ("5", "bo ek"), ("6", "uma marlowe"), ("7", "cher")], "rival_id string, name string")
    got = {r.slug: (r.rival_id, r.match_confidence) for r in matching.match(home, rival).collect()}
    # two rivals share s3's name, so the one at distance 1 is hers
    assert got == {"s1": ("1", "medium"), "s3": ("6", "low"), "s5": ("5", "medium"), "s6": ("7", "medium")}


def plain_match(home, rival):
    """The three tiers by comparing everyone with everyone, in order of slug."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def ordered(a, b):
        short, long = sorted((a.split(), b.split()), key=len)
        rest = iter(long)
        return len(short) > 1 and len(long) - len(short) <= 2 and short[0] == long[0] and short[-1] == long[-1] and all(w in rest for w in short)

    left, out = dict(rival), {}
    for slug, key in sorted(home):
        words = key.split()
        block = {r: k for r, k in left.items() if (k[0], k.split()[-1]) == (key[0], words[-1]) and len(k.split()) > 1 and len(words) > 1 or k == key}
        same = [r for r, k in block.items() if k == key]
        near = [r for r, k in block.items() if len(words) > 1 and (k == key or ordered(k, key))]
        far = sorted((distance(k, key), r) for r, k in block.items() if len(words) > 1 and 0 < distance(k, key) <= 2)
        far = [r for d, r in far if d == far[0][0]]
        for found, sure in ((same, "medium"), (near, "low"), (far, "low")):
            if len(found) == 1:
                out[slug] = (found[0], sure)
                del left[found[0]]
                break
    return out


def test_matching_by_brute_force(spark):
    rng = random.Random(7)
    firsts, middles, lasts = ["ann", "anna", "anne", "ana", "bob", "bo"], ["", "", "jo", "lee jo", "max"], ["ek", "ekk", "brook", "marlowe"]
    person = lambda: " ".join(x for x in (rng.choice(firsts), rng.choice(middles), rng.choice(lasts)) if x)
    home, rival = [(f"s{i:03}", person()) for i in range(90)] + [("s500", "cher")], [(f"r{i:03}", person()) for i in range(70)] + [("r500", "cher")]
    got = matching.match(spark.createDataFrame(home, "slug string, name string"), spark.createDataFrame(rival, "rival_id string, name string"))
    want = plain_match(home, rival)
    assert {r.slug: (r.rival_id, r.match_confidence) for r in got.collect()} == want
    assert {s for _, s in want.values()} == {"medium", "low"} and len(want) > 15


def test_links(spark):
    links = spark.createDataFrame([("a", "1", "low", "2024-01-02"), ("a", "2", "high", "2024-01-01"), ("b", "1", "odd", "2024-01-01"), ("b", "2", "odd", "2024-01-03")], "slug string, rival_id string, match_confidence string, matched_at string")
    assert {r.slug: r.rival_id for r in compare.preferred_links(links).collect()} == {"a": "2", "b": "2"}
    assert {r.slug: r.rival_id for r in compare.preferred_links(links, spark.createDataFrame([("1",)], "rival_id string")).collect()} == {"a": "1", "b": "1"}
    home = spark.createDataFrame([("a", "7"), ("b", "8")], "slug string, number string")
    rival = spark.createDataFrame([("1", "7"), ("2", "9")], "rival_id string, number string")
    kept = compare.checked_links(links.withColumn("match_method", F.lit("name")), home, rival).collect()
    assert [(r.slug, r.rival_id, r.match_confidence, r.match_method) for r in kept] == [("a", "1", "high", "number_match")]


def test_stars_are_those_of_all_pairs():
    rng = random.Random(4)
    rows = [("r", "bio", f"s{i}", f"u{rng.randint(0, 5)}", f"f{i}", rng.choice(["high", "medium", "low", None]), [f"w{rng.randint(0, 12)}" for _ in range(rng.randint(0, 6))]) for i in range(300)]
    taken, want = set(), []
    for i, r in enumerate(rows):
        if i not in taken:
            x = set(r[-1])
            alike = [j for j in range(i + 1, 300) if j not in taken and rows[j][3] != r[3] and x & set(rows[j][-1]) and len(x & set(rows[j][-1])) >= 0.4 * len(x | set(rows[j][-1]))]
            taken.update(alike)
            want.append([r[2], *(rows[j][2] for j in alike)])
    assert [star[2] for star in corroboration._stars(rows, 0.4)] == want and taken


def test_corroboration(spark):
    facts = [{"element": "bio", "fact": "Leads knee surgery unit", "confidence": "low"}, {"element": "bio", "fact": "plays chess", "confidence": "high"}]
    other = [{"element": "bio", "fact": "leads the knee surgery unit!", "confidence": "high"}]
    rows = [("r", 0, "a", "u1", facts), ("r", 1, "b", "u2", other), ("r", 2, "c", "u1", other), ("r", 3, "d", "u4", None)]
    sources = spark.createDataFrame(rows, "rewrite_id string, source_ord int, source_id string, result_url string, facts array<struct<element:string,fact:string,confidence:string>>")
    got = sorted((r.fact, r.confidence, r.source_ids, r.source_urls, r.corroborated) for r in corroboration.corroborate(corroboration.from_sources(sources)).collect())
    # the third source's fact shares the first one's address, so it stands alone
    assert got == [("leads the knee surgery unit!", "high", ["a", "b"], ["u1", "u2"], True), ("leads the knee surgery unit!", "high", ["c"], ["u1"], False), ("plays chess", "high", ["a"], ["u1"], False)]
    assert corroboration.fact_total(sources).first().facts == 4


def test_stream(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(f"{sf_dir}/pages.parquet").write.parquet(str(source))
    for _ in range(2):  # the second finds nothing new
        q = ingest_pages(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(source)).count()
    assert windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).count() > 0


RIVAL = """<title>Dr Wilma Tarn | clinic pages</title><main><p class="not-fee-assured">no agreed fees</p>
<section><h3>Practises at</h3><ol><li>South Ward</li><li>North Ward</li><li>South Ward</li></ol></section><section><h3>Favourite walks</h3><p>Coast path</p></section>
<section><h3>Registration</h3><p>since 1999, no. 0070315</p></section><section><h3>Languages</h3><p>Welsh, Cornish</p></section>
<table><tr><td>Web</td><td><a href="https://tarn.example/feet">her website</a> <a href="/local">website</a></td></tr><tr><td>Desk</td><td><a data-tel-href="tel:01632 960123">  </a><a href="tel:0163">01632 960 456</a><a href="tel:0163">01632  960 456</a></td></tr></table>
<footer><img alt="ACCREDITED foot school" src="/b.png"><img alt="Dr Wilma Tarn" src="/w.png"><a href="mailto: desk@tarn.example">write</a></footer></main>
<section><h3>Biography</h3><p>Looks after feet.</p><p>And gait.</p></section>"""
OTHER_RIVAL = """<body data-consultant-name="Dr Otto Quill" data-gmc="0000812345"><div class="about-text">He has long looked after ankles.</div></body>"""


def test_parse_rival(spark):
    r = html.parse_rival(spark.createDataFrame([("1", RIVAL), ("2", None), ("3", OTHER_RIVAL)], "rival_id string, html string")).orderBy("rival_id").collect()
    a = r[0]
    assert (a["name"], a.registration_number, a.has_photo, a.about_text, a.fee_assured) == ("Dr Wilma Tarn", "70315", False, "Looks after feet. And gait.", False)
    assert (a.hospitals, a.languages, a.unmapped, a.badges) == (["South Ward", "North Ward"], ["Welsh", "Cornish"], ["favourite_walks"], ["ACCREDITED foot school"])
    assert (a.phones, a.emails, a.websites) == (["01632 960123", "01632 960 456"], ["desk@tarn.example"], ["https://tarn.example/feet"])
    assert a.specialty_primary == a.specialty_sub == a.memberships == a.treatments == a.clinical_interests == []
    assert a.sections["biography"]["values"] == ["Looks after feet.", "And gait."] and r[1]["name"] is None and r[1].memberships == []
    assert (r[2]["name"], r[2].registration_number, r[2].about_text, r[2].phones) == ("Dr Otto Quill", "812345", "He has long looked after ankles.", [])


def test_photos_and_truncate(spark, tmp_path):
    (tmp_path / "ann-lee.png").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"y")
    assert [tuple(r) for r in sitemaps.photos(spark, str(tmp_path)).collect()] == [("ann-lee", "image/png", bytearray(b"x"))]
    path = str(tmp_path / "t")
    snapshots.append_rows(spark.range(3), path)
    snapshots.append_rows(spark.range(2), path)
    assert spark.read.parquet(path).count() == 5
    snapshots.truncate(spark, path)
    assert spark.read.parquet(path).count() == 0
    rows = spark.createDataFrame([("1", "1"), ("1", "2"), ("1", None), (None, "2"), (None, None)], "h string, r string")
    assert [r[0] for r in rows.select(compare.number_status(F.col("h"), F.col("r"))).collect()] == ["match", "mismatch", "missing_on_rival", "missing_on_home", "missing_both"]


def profiles_of(spark, rows):
    """Scored profiles (slug, name, tier, score, price) with empty arrays elsewhere."""
    df = spark.createDataFrame(rows, "slug string, name string, tier string, score double, price double")
    empty = F.array().cast("array<string>")
    return df.withColumns({"site": F.lit(None).cast("string"), "booking_state": F.lit("not_bookable"), "bio_depth": F.lit("thin"), "has_photo": F.lit(None).cast("boolean"), "plain_english_score": F.lit(3), "slots_28_days": F.lit(None).cast("int"), "insurers": empty, "specialty_primary": empty, "flags": F.array().cast("array<struct<code:string,severity:string,message:string>>")})


def test_tools(spark):
    scored = profiles_of(spark, [(f"s{i:02}", f"N {9 - i % 10}", "Gold", float(i), float(-i)) for i in range(60)])
    one = tools.execute(scored, "search_profiles", {"score_min": 10, "sort_by": "price_asc", "limit": 99})
    assert len(one.columns) == 15 and [r.slug for r in one.orderBy("price").collect()][:2] == ["s59", "s58"] and one.count() == 50 and one.first().total == 50
    assert tools.execute(scored, "search_profiles", {}).count() == 20 and filters.clamp_limit(None) == 20 and filters.clamp_limit(99) == 50
    assert len(tools.execute(scored, "profile_detail", {"name": "n 3"}).columns) == 28 and tools.execute(scored, "profile_detail", {"slug": "none"}).count() == 0
    for bad in (("odd", {}), ("profile_detail", {})):
        try:
            tools.execute(scored, *bad)
            raise AssertionError("no error")
        except ValueError:
            pass


def test_reports_in_csv(spark):
    scored = profiles_of(spark, [("b", "B, \"x\"", "Gold", 1.5, 2.0), ("a", "A", "Gold", 3.0, None), ("c", "C", "Bronze", 3.0, None)])
    header, lines = sinks.report_lines(scored, ["name", "price", "password", "online_bookable"], "Gold")
    assert header == "Name,Consultation Price,Online Bookable" and [r.line for r in lines.collect()] == ["A,,false", '"B, ""x""",2.0,false']
    header, lines = sinks.action_plan(spark.createDataFrame([(2, "Do, so", 3, 12.5, 37.5), (1, "Act", 4, 10.0, 40.0)], "rank int, action string, profiles long, points double, impact double"))
    assert header == "Rank,Action,Profiles Affected,Points Per Profile,Total Impact" and [r.line for r in lines.collect()] == ['1,"Act",4,10,40', '2,"Do, so",3,12.5,37.5']
    for columns in ([], ["password"]):
        try:
            sinks.report_lines(scored, columns)
            raise AssertionError("no error")
        except ValueError:
            pass


def test_exports_are_cut_and_audited(spark, tmp_path):
    rows = [(f"s{i}", f"N {i % 7}", "Gold", float(i), None) for i in range(40)]
    scored = profiles_of(spark, rows).withColumns({"run_id": F.lit("r1"), "phone": F.lit("01632960001"), "tags": F.array(F.lit("a"), F.lit("b"))})
    lines = lambda name: [r.value for r in spark.read.text(f"{tmp_path}/{name}").collect()]
    audit = f"{tmp_path}/audit"
    header = sinks.export_profiles(scored, f"{tmp_path}/a", filters.ProfileFilter(least_score=5), "score", True, audit=audit, most=10)
    assert "phone" not in header and len(lines("a")) == 10 and all("01632960001" not in x for x in lines("a")) and not snapshots.exists(spark, audit)
    assert [x.split(",")[0] for x in lines("a")] == [f"s{i}" for i in range(39, 29, -1)] and '"[""a"",""b""]"' in lines("a")[0]
    assert "phone" in sinks.export_profiles(scored, f"{tmp_path}/b", contacts=True, audit=audit, by="10.0.0.1", most=20_000) and len(lines("b")) == 40 and "01632960001" in lines("b")[0]
    assert [(r.action, r.run_id, r.by) for r in spark.read.schema(sinks.AUDIT).json(audit).collect()] == [("export_with_contact_data", "r1", "10.0.0.1")]
    try:
        sinks.export_profiles(scored, f"{tmp_path}/c", filters.ProfileFilter(least_score=500), contacts=True, audit=audit)
        raise AssertionError("no error")
    except ValueError:
        assert spark.read.json(audit).count() == 1


def test_small_relations(spark, tmp_path):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(compare.display_lead(F.lit(a).cast("double"), F.lit(b).cast("double"))) for a, b in ((None, 3), (3, None), (5, 6), (None, None))] == ["rival", "home", "tie", "tie"]
    assert one(scoring.capped(F.lit(8), F.lit(5), F.lit(10))) == 10
    rows = spark.createDataFrame([("r", True), ("r", False), ("r", False)], "rewrite_id string, corroborated boolean")
    assert tuple(desk.sources_by_support(rows).first()) == ("r", 1, 2)
    profile = spark.createDataFrame([("r", "s", "word " * 160, None, ["t"] * 5, [], [], None)], "run_id string, slug string, about_text string, qualifications string, treatments array<string>, specialty_sub array<string>, memberships array<string>, practising_since int")
    assert {r.element for r in scoring.elements(profile).where("selected").collect()} == {"qualifications", "specialty_sub", "memberships", "practising_since"}
    known = spark.createDataFrame([("a", "parse_done", "x"), ("b", "error", None)], "slug string, scrape_status string, about_text string")
    got = snapshots.with_earlier(spark.createDataFrame([("a",), ("z",)], "slug string"), known, ["about_text"]).orderBy("slug").collect()
    assert [tuple(r) for r in got] == [("a", "parse_done", "x"), ("z", None, None)]
    source, target = str(tmp_path / "from"), str(tmp_path / "to")
    snapshots.write_run(spark.createDataFrame([("r1", "a", 1), ("r2", "a", 2)], "run_id string, slug string, n int"), source)
    snapshots.copy_run(spark, source, target, "r2")
    assert [(r.run_id, r.n) for r in spark.read.parquet(target).collect()] == [("r2", 2)]
    places = spark.createDataFrame([("a", 1.0, 5.0), ("b", 3.0, 2.0)], "site string, x double, y double")
    assert [r.site for r in filters.resorted(places, "y", "site", ["x", "y"]).collect()] == ["a", "b"] and [r.site for r in filters.resorted(places, "x", "site", ["x", "y"], descending=False).collect()] == ["a", "b"]
    nulls = spark.createDataFrame([(None,), ("Gold",), (None,)], "tier string")
    assert {r.name: r.n for r in metrics.group_count(nulls, "tier", other=metrics.UNKNOWN).collect()} == {"Unknown": 2, "Gold": 1}
