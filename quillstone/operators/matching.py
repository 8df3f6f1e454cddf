"""One-to-one matching of people by name.

Three tiers: equal names, then equal first and last word with the shorter name's words in order within the longer, then
equal first letter and last word at edit distance 1 or 2. In each a candidate must be the only one left. A match uses its candidate
up, so order counts: home rows go by slug. Every tier implies the same last word and first letter.

Candidates are found between distinct names, by keys that two names share only if they may be candidates, so a last name that a hundred thousand rows have is no all-pairs job. Names within two edits share a text that two
deletions or fewer leave of each: these are the keys, of what stands between the first letter and the last word. Middles too long for that are cut into three parts, of which two edits leave one whole. Names whose words lie
in order within each other share the words that two deletions or fewer leave. A name that several rivals share never gives a match but stands in the way of others, so it goes on as one row.

In small blocks (one initial with one last name) the rows are gone through one by one. In larger ones the order is settled in rounds, as joins: every home row chooses among the rivals that no earlier row is known to use, every rival is then used by the first row by slug that chose it, and so on until nothing changes. What is
right for the first k rows stays so, and the next round is right for one more at least; the one state that no round changes is that of going through the rows one by one. Rows
that wait for each other in a chain take a round each, others settle together.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import core_signature, loose_signature, name_key
from quillstone.operators.grouping import map_groups
from quillstone.sources.shared import remove, stored, stored_at

#: middles of up to so many characters have keys by deletion, from three fewer on (also) by parts
LONG = 42


def in_order(a: Column, b: Column) -> Column:
    """Whether two names' first and last words are equal and all words of the shorter, at most two fewer, are in order within the longer."""
    x, y = F.split(a, " "), F.split(b, " ")
    short, long = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    met = F.aggregate(long, F.lit(0), lambda n, w: n + F.coalesce(F.get(short, n) == w, F.lit(False)).cast("int"))
    return (F.size(short) >= 2) & (F.size(long) - F.size(short) <= 2) & (core_signature(a) == core_signature(b)) & (met == F.size(short))


def _upto(n: Column) -> Column:
    """1 to n; nothing for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _shorter(text: Column) -> Column:
    """What each single deletion leaves of a text."""
    return F.transform(_upto(F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))


def _fewer(words: Column) -> Column:
    """What each single deletion leaves of an array."""
    return F.transform(_upto(F.size(words)), lambda i: F.concat(F.slice(words, F.lit(1), i - 1), F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0)))))


def _parts(middle: Column, probe: bool) -> Column:
    """Keys of a long middle: its three parts with its length and their number; or, as a probe, every text that may be such a part of a middle within two edits."""
    n, numbers = F.length(middle), lambda low, high: F.sequence(F.lit(low), F.lit(high))
    each = lambda low, high, f: F.flatten(F.transform(numbers(low, high), f))

    def part(size, k, shift):
        start = F.floor(size * k / 3).cast("int")
        return F.concat_ws("/", size, k, F.substring(middle, start + 1 + shift, F.floor(size * (k + 1) / 3).cast("int") - start))

    near = 2 if probe else 0
    keys = each(-near, near, lambda d: each(0, 2, lambda k: F.transform(numbers(-near, near), lambda shift: part(n + d, k, shift))))
    return F.when(n >= LONG - 3, F.array_distinct(keys)).otherwise(F.array().cast("array<string>"))


def _keyed(names: DataFrame, name: str, probe: bool) -> DataFrame:
    """(block, key, gone, name): the keys of distinct names (block, name). gone: how much is left out of a middle or its words. Two names within two edits share a key of which two letters are left out of the longer one, unless that is shorter than two."""
    words, key, middle, inner = F.col("words"), F.col(name), F.col("middle"), F.col("inner")
    entry = lambda kind, gone: lambda t: F.struct(F.concat(F.lit(kind), t).alias("key"), F.lit(gone).alias("gone"))
    none = F.array().cast("array<struct<key:string,gone:int>>")
    # a step at a time, so that nothing is worked out twice
    rows = names.select("block", name).withColumn("words", F.split(name, " "))
    rows = rows.withColumns({"middle": F.substring(key, F.lit(2), F.length(key) - F.length(F.element_at(words, -1)) - 2), "inner": F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))})
    rows = rows.withColumns({"m1": F.when(F.length(middle) <= LONG, _shorter(middle)), "w1": _fewer(inner)})
    rows = rows.withColumns({"m2": F.array_distinct(F.flatten(F.transform("m1", _shorter))), "w2": F.array_distinct(F.flatten(F.transform("w1", _fewer)))})
    short = F.when(F.length(middle) <= LONG, F.concat(F.array(entry("e/", 0)(middle)), F.transform(F.array_distinct("m1"), entry("e/", 1)), F.transform("m2", entry("e/", 2)))).otherwise(none)
    long = F.transform(_parts(middle, probe), entry("p/", 2))
    start = F.concat(F.lit("w/"), words[0], F.lit("/"))
    order = F.concat(*[F.transform(w, lambda x, k=k: F.struct(F.concat(start, F.array_join(x, " ")).alias("key"), F.lit(k).alias("gone"))) for k, w in ((0, F.array(inner)), (1, F.array_distinct("w1")), (2, F.col("w2")))])
    alone = F.array(F.struct(F.lit("=").alias("key"), F.lit(2).alias("gone")))  # one word: its block is the name
    keys = F.when(F.size(words) < 2, alone).otherwise(F.concat(short, long, order))
    return rows.select("block", name, F.length(middle).alias("size"), F.explode(keys).alias("k")).select("block", "k.key", "k.gone", "size", name)


def candidates(home: DataFrame, rival: DataFrame) -> DataFrame:
    """(block, home_key, rival_key, rival_id, near, distance) between distinct names of (key, block) and (key, block, rival_id): rival_id is null where several share the name."""
    h = home.select("block", F.col("key").alias("home_key")).distinct()
    r = rival.groupBy("block", F.col("key").alias("rival_key")).agg(F.when(F.count(F.lit(1)) == 1, F.min("who")).alias("rival_id"))
    met = _keyed(h, "home_key", True).alias("h").join(_keyed(r, "rival_key", False).alias("r"), ["block", "key"])
    most = F.greatest("h.gone", "r.gone")
    edits = (most == 2) | (most == F.greatest("h.size", "r.size"))  # equal names share many keys, others few
    met = met.where(F.when(F.col("key").startswith("w/"), F.least("h.gone", "r.gone") == 0).otherwise(edits)).select("block", "home_key", "rival_key").distinct()
    two = F.size(F.split("home_key", " ")) >= 2
    pairs = met.withColumns({"near": two & ((F.col("home_key") == F.col("rival_key")) | in_order(F.col("home_key"), F.col("rival_key"))), "distance": F.levenshtein("home_key", "rival_key", 2)})
    pairs = pairs.where((F.col("distance") == 0) | F.col("near") | (two & (F.col("distance") > 0)))
    return pairs.join(r, ["block", "rival_key"])


def chosen(options: DataFrame, used: DataFrame | None) -> DataFrame:
    """(rival_key, slug, rival_id, match_confidence): which row uses each rival name, if rows see as used what earlier rows use in `used`."""
    if used is not None:
        options = options.join(used.select("rival_key", F.col("slug").alias("by")), "rival_key", "left").where("by is null or by >= slug")
    one = F.struct("rival_key", "rival_id")
    tiers = {"same": F.col("distance") == 0, "close": F.col("near"), "far1": F.col("distance") == 1, "far2": F.col("distance") == 2}
    counts = options.groupBy("slug").agg(*[F.struct(F.count(F.when(c, 1)).alias("n"), F.min(F.when(c, one)).alias("one")).alias(k) for k, c in tiers.items()])
    far = F.when(F.col("far1.n") > 0, F.col("far1")).otherwise(F.col("far2"))
    only = lambda t: (t.n == 1) & t.one.rival_id.isNotNull()
    pick = F.when(only(F.col("same")), F.struct(F.col("same.one").alias("one"), F.lit("medium").alias("sure")))
    for t in (F.col("close"), far):
        pick = pick.when(only(t), F.struct(t.one.alias("one"), F.lit("low").alias("sure")))
    choices = counts.select("slug", pick.alias("p")).where("p is not null").select("slug", "p.one.rival_key", "p.one.rival_id", F.col("p.sure").alias("match_confidence"))
    return choices.groupBy("rival_key").agg(F.min_by(F.struct("slug", "rival_id", "match_confidence"), "slug").alias("c")).select("rival_key", "c.*")


def by_rounds(options: DataFrame) -> DataFrame:
    """(slug, rival_id, match_confidence) from (slug, rival_key, rival_id, near, distance)."""
    state = used = path = None
    while True:
        last, last_path = state, path
        used, path = stored_at(chosen(options, used), "used")
        state = tuple(used.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("rival_key", "slug", "match_confidence"))).first())
        if last_path:
            remove(used.sparkSession, last_path)
        if state == last or not state[0]:
            return used.select("slug", "rival_id", "match_confidence")


def _one_by_one(rows: list[tuple]) -> list[tuple]:
    """by_rounds for a block's rows (block, slug, rival_key, rival_id, near, distance), sorted by slug."""
    used, out = set(), []
    for slug, some in groupby(rows, key=lambda r: r[1]):
        left = [r for r in some if r[2] not in used]
        nearest = min((r[5] for r in left if r[5] > 0), default=None)
        tiers = ([r for r in left if r[5] == 0], "medium"), ([r for r in left if r[4]], "low"), ([r for r in left if r[5] == nearest], "low")
        for found, sure in tiers:
            if len(found) == 1 and found[0][3] is not None:
                used.add(found[0][2])
                out.append((slug, found[0][3], sure))
                break
    return out


def match(home: DataFrame, rival: DataFrame, most: int = 20_000) -> DataFrame:
    """(slug, rival_id, match_confidence) for home (slug, name) and rival (rival_id, name). Nameless rows match nobody. Blocks of up to `most` candidate pairs are gone through row by row, many to a task, larger ones in rounds."""

    def keyed(df, id_col):
        k = df.select(F.col(id_col).alias("who"), name_key(F.col("name")).alias("key")).where(F.col("key") != "").dropDuplicates(["who"])
        return k.withColumn("block", F.coalesce(loose_signature(F.col("key")), F.col("key")))

    mine = keyed(home, "slug")
    pairs = candidates(mine, keyed(rival, "rival_id")).drop("block").withColumnRenamed("home_key", "key")
    # a name without a single rival among its candidates can never match, nor use one up
    free = pairs.groupBy("key").agg(F.count("rival_id").alias("n")).where("n > 0").select("key")
    options = stored(mine.join(pairs.join(free, "key", "left_semi"), "key").select("block", F.col("who").alias("slug"), "rival_key", "rival_id", "near", "distance"), "options")
    large = stored(options.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("block"), "large-blocks")
    names, schema = ["slug", "rival_key", "rival_id", "near", "distance"], "slug string, rival_id string, match_confidence string"
    if large.isEmpty():
        return map_groups(options, ["block"], ["slug"], lambda key, rows: _one_by_one(rows), schema)
    small = map_groups(options.join(large, "block", "left_anti"), ["block"], ["slug"], lambda key, rows: _one_by_one(rows), schema)
    # rival names are told apart by their text: a block is in it
    return small.union(by_rounds(stored(options.join(large, "block", "left_semi").select(*names), "large-options")))
