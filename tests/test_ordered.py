"""Ordered work: groups cut into slices must give what plain windows give, and match brute force."""

import random

import pytest
from pyspark.sql import functions as F

from pagevault.operators import chunks as C
from pagevault.operators import elements as E
from pagevault.operators import search as S
from pagevault.operators import tabs as T
from pagevault.operators import versions as V
from pagevault.operators.ordered import arrange, fill_forward, group_total, number_rows, running_sum, shift
from pagevault.streaming import interactions as X

SLICED = True


@pytest.fixture(scope="module")
def skewed(spark):
    """One hot key with most rows, a NULL key, and small ones."""
    rng = random.Random(7)
    rows = []
    for i in range(400):
        key = "hot" if i % 3 else (None if i % 2 else f"k{i % 7}")
        rows.append((key, i, rng.randrange(10), None if rng.random() < 0.6 else f"v{i}"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, pos long, n long, v string").repartition(5)


@pytest.mark.parametrize("limit", [True, False])
def test_primitives_against_brute_force(skewed, limit):
    a = arrange(skewed, ["k"], ["pos"], limit)
    assert a.sliced == limit
    a = number_rows(a, "rn")
    a = running_sum(a, total=F.col("n"))
    a = shift(a, b1=(F.col("n"), 1), b3=(F.col("v"), 3), f2=(F.col("n"), -2))
    a = fill_forward(a, seen=F.col("v"))
    a = group_total(a, size=F.count(F.lit(1)))
    got = {(r["k"], r["pos"]): r for r in a.result().collect()}
    groups = {}
    for r in sorted(skewed.collect(), key=lambda r: r["pos"]):
        groups.setdefault(r["k"], []).append(r)
    assert len(got) == 400
    for k, rows in groups.items():
        total, seen = 0, None
        for i, r in enumerate(rows):
            total += r["n"]
            seen = r["v"] or seen
            g = got[(k, r["pos"])]
            assert (g["rn"], g["total"], g["seen"], g["size"]) == (i + 1, total, seen, len(rows))
            assert g["b1"] == (rows[i - 1]["n"] if i >= 1 else None)
            assert g["b3"] == (rows[i - 3]["v"] if i >= 3 else None)
            assert g["f2"] == (rows[i + 2]["n"] if i + 2 < len(rows) else None)


def test_all_rows_as_one_group(skewed):
    a = number_rows(arrange(skewed, [], ["pos"]), "rn")
    assert all(r["rn"] == r["pos"] + 1 for r in a.result().collect())


def test_throttle(spark, rows):
    rng = random.Random(3)
    events, t = [], 0
    for i in range(600):
        t += rng.choice([0, 1, 40, 90, 260])
        events.append((i, t, "hot" if i % 3 else "cold"))
    df = spark.createDataFrame(events, "event_id long, ms long, user string").withColumn("ts", F.timestamp_millis("ms"))
    want, last = [], {}
    for i, ms, user in events:
        if user not in last or ms - last[user] > 250:
            last[user] = ms
            want.append((i,))
    want = sorted(want, key=lambda r: str(r[0]))
    assert rows(X.throttle(df, ["user"]), "event_id") == want
    assert rows(X.throttle(df, ["user"], sliced=SLICED), "event_id") == want


def _profiles(texts):
    """The greedy reading of a list of texts, as a loop."""
    out, i = [], 0
    while i < len(texts) - 1:
        h = texts[i + 1]
        if "@" in h or h.endswith(".com"):
            b = texts[i + 2] if i + 2 < len(texts) else None
            next_pair = i + 3 < len(texts) and "@" in texts[i + 3]
            if b is not None and len(b) > 10 and not b.startswith("@") and not next_pair:
                out.append((i, b))
                i += 3
            else:
                out.append((i, None))
                i += 2
        else:
            i += 1
    return out


@pytest.mark.parametrize("limit", [True, False])
def test_name_handle_bio(spark, limit):
    rng = random.Random(11)
    data, want = [], {}
    for doc, n in (("hot", 300), ("a", 9), ("b", 1)):
        texts = [rng.choice(["@h", "x.com", "Name", "a long biography", "@another handle"]) for _ in range(n)]
        data += [(doc, i, t) for i, t in enumerate(texts)]
        want[doc] = _profiles(texts)
    df = spark.createDataFrame(data, "doc string, pos long, text string").repartition(4)
    got = {}
    for r in E.name_handle_bio(df, sliced=limit).orderBy("doc", "pos").collect():
        got.setdefault(r["doc"], []).append((r["pos"], r["bio"]))
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("name", ["runs", "posts", "images", "section", "titles", "slugs", "dates", "chunks", "polls", "bursts", "updates"])
def test_sliced_equals_plain(spark, rows, name):
    rng = random.Random(5)
    data = []
    for i in range(300):
        doc = "hot" if i % 4 else f"d{i % 5}"
        kind = rng.choice(["text", "text", "image", "title", "list_item"])
        text = rng.choice(["About us", "Apr 8", "short", "a somewhat longer text here", "@u", "12K", "Ana's profile picture"])
        data.append((doc, i, kind, text, f"http://i/{rng.randrange(12)}" if kind == "image" else None))
    df = spark.createDataFrame(data, "doc string, pos long, kind string, text string, image_url string")
    user = F.when(F.col("doc") == "hot", 1).otherwise(2)
    makers = {
        "runs": lambda m: E.merge_text_runs(df, "doc", ["pos"], "kind", "text", sliced=m),
        "posts": lambda m: E.segment_avatar_posts(df, "doc", ["pos"], sliced=m),
        "images": lambda m: E.segment_by_image(df, sliced=m),
        "section": lambda m: E.section_by_title(df, "about", sliced=m),
        "titles": lambda m: E.title_sections(df, "doc", ["pos"], "kind", "text", sliced=m),
        "slugs": lambda m: T.slug_unique(df, "text", ["pos"], m),
        "dates": lambda m: E.nearby_date(df, sliced=m),
        "chunks": lambda m: C.number_chunks(df, "doc", ["pos"], m),
        "polls": lambda m: T.poll_changes(df.select(user.alias("tab_id"), F.col("pos").alias("poll"), F.col("text").alias("url")), sliced=m),
        "bursts": lambda m: X.debounce(df.select("doc", "pos", F.timestamp_millis(F.col("pos") * 400).alias("ts")), "doc", gap_ms=750, event_id="pos", sliced=m),
        "updates": lambda m: X.interaction_updates_table(df.select(user.alias("tab_id"), F.col("pos").alias("ts"), F.col("kind").alias("url"), "text"), sliced=m),
    }
    make = makers[name]
    plain, cut = make(False), make(True)
    cols = sorted(plain.columns)
    assert plain.count() > 0
    assert rows(plain, *cols) == rows(cut, *cols)


def test_version_chain_sliced_equals_plain_and_difflib(spark, rows):
    from difflib import SequenceMatcher

    rng = random.Random(2)
    data, texts = [], []
    for i in range(120):
        prev = texts[-1] if texts else ["a"]
        blocks = list(prev)
        roll = rng.random()
        if roll < 0.3:
            blocks = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))]
        elif roll < 0.5:
            blocks = blocks[::-1]
        elif roll < 0.8:
            blocks.insert(rng.randrange(len(blocks) + 1), rng.choice("abcdefgh"))
        texts.append(blocks)
        data.append(("u", i, "\n\n".join(blocks)))
    want, chain = [], -1
    for i, new in enumerate(texts):
        old = texts[i - 1] if i else None
        same = old is not None and (
            old == new or sum(b.size for b in SequenceMatcher(a=old, b=new, autojunk=False).get_matching_blocks()) / len(new) >= 0.3
        )
        chain += not same
        want.append((i, chain))
    df = spark.createDataFrame(data, "url string, ver long, text string")
    for limit in (False, True):
        got = V.version_chain(df, "url", ["ver"], "text", sliced=limit).select("ver", "chain").orderBy("ver").collect()
        assert [tuple(r) for r in got] == want


def test_embed_batches(spark):
    df = spark.range(1000).withColumn("kind", F.when(F.col("id") % 3 == 0, "a"))
    got = S.embed_batches(df, 64, ["id"]).collect()
    assert all(r["batch_id"] == r["id"] // 64 for r in got)
    by_kind = S.embed_batches(df, 64, ["id"], "kind").groupBy("kind", "batch_id").count().collect()
    assert max(r["count"] for r in by_kind) == 64 and sum(r["count"] for r in by_kind) == 1000


def test_inside_others_against_all_pairs():
    rng = random.Random(1)
    for _ in range(200):
        lines = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, rng.choice([4, 14, 30])))) for _ in range(rng.randint(0, 12))]
        lines += [x[rng.randint(0, 3) :] or "q" for x in lines[:3]] + ["prefix prefix " + x for x in lines[:4]]
        want = [x in lines[:i] or any(x in y for y in lines if y != x) for i, x in enumerate(lines)]
        assert E.inside_others(lines) == want
