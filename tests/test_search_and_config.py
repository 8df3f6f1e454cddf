"""Substring search through an index against scans; the shared configuration under a race."""

import json
import random
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quillstone.config import ScoringConfig, SharedConfig
from quillstone.functions.text import any_of
from quillstone.operators import search
from quillstone.sources import buckets


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("search"), random.Random(6)
    words = ["Ann", "Bo%b", "c_d", "ÉLAN", "İstanbul", "knee", "back\\slash", "Maßnahme", "Kelvin", "x"]
    rows = [(f"r{i % 2}", f"s{i:04}", " ".join(rng.choice(words) for _ in range(rng.randrange(4))) if i % 9 else None, f"site {rng.randrange(300)}") for i in range(1500)]
    rows.append(("r0", "rare", "zebra crossing", "Q"))
    buckets.write(spark.createDataFrame(rows, "run_id string, slug string, name string, site string"), f"{folder}/t", 32)
    for run in ("r0", "r1", "r0"):  # an index is replaced a run at a time
        search.build(buckets.read(spark, f"{folder}/t").where(F.col("run_id") == run), f"{folder}/i")
    return f"{folder}/t", f"{folder}/i"


TERMS = ["knee", "KNEE", "zebra", "zeb_a cr%ing", "o%b", "Bo\\%b", "c_d", "c\\_d", "élan", "ÉLAN", "istan", "i̇stan", "kelvin", "back\\\\slash", "nowhere", "kn", "%", "", "site 29", "bra%cro", "nahme ann"]


@pytest.mark.parametrize("term", TERMS)
def test_search_equals_a_scan(spark, indexed, term):
    table, index = indexed
    rows = buckets.read(spark, table).where("run_id = 'r0'")
    want = {r.slug for r in rows.where(any_of([F.col(c).ilike(f"%{term}%") for c in search.COLUMNS])).collect()}
    assert {r.slug for r in search.search(spark, table, index, "r0", term, n_buckets=32).collect()} == want


def test_rare_terms_read_few_buckets(spark, indexed):
    table, index = indexed
    found = search.search(spark, table, index, "r0", "zebra", n_buckets=32)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 1 and re.search(r"PartitionFilters: \[[^]]*bucket#\d+ (=|IN \() ?\d+\)", plan)  # one of 32
    assert search.hits(spark, index, "r0", "nowhere").count() == 0 and search.hits(spark, index, "r0", "a_b") is None
    assert search.parts_of_term("ab%cdef_g\\%hi") == ["%hi", "cde", "def", "g%h"]


def test_no_change_is_lost_in_a_race(spark, tmp_path):
    shared = SharedConfig(spark, f"file://{tmp_path}/config")
    assert shared.read() == ScoringConfig() and shared.versions() == []
    with ThreadPoolExecutor(8) as pool:
        saved = list(pool.map(lambda i: SharedConfig(spark, f"file://{tmp_path}/config").save({"thresholds": {"Gold": 70 + i}}, f"writer {i}"), range(24)))
    assert sorted(c.version for c in saved) == shared.versions() == list(range(2, 26))
    assert {shared.read(c.version).updated_by for c in saved} == {f"writer {i}" for i in range(24)}
    assert shared.read() == max(saved, key=lambda c: c.version)
    assert [p.name for p in (tmp_path / "config").iterdir() if p.suffix != ".json" and not p.name.endswith(".crc")] == []


def test_two_changes_of_different_values_stay(spark, tmp_path):
    shared = SharedConfig(spark, str(tmp_path / "config"))

    def grow(i):
        def edit(raw):
            raw["weights"] = raw["weights"] | {"booking": 10.0}
            raw["thresholds"] = raw["thresholds"] | {"Gold": raw["thresholds"]["Gold"] + 1}
            return raw

        return SharedConfig(spark, str(tmp_path / "config")).change(edit, str(i))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(grow, range(12)))
    assert shared.read().thresholds["Gold"] == 92 and shared.versions() == list(range(2, 14))
    with pytest.raises(ValueError):
        shared.save({"thresholds": {"Gold": 1}}, "x")
    (tmp_path / "config" / "v-99.json").write_text("{")
    assert shared.read() == ScoringConfig() and json.loads((tmp_path / "config" / "v-2.json").read_text())["version"] == 2
    assert shared.reset("y").version == 100
