import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from rows import ODD

from wardlens.llm import chat, hashtree, queries, toxicity


# hash tree ----------------------------------------------------------------
def check_shards(rows, docs):
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and r["law"] == "key" and 0 <= r["shard"] < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert len({(r["doc_id"], r["shard"]) for r in rows}) == len({r["doc_id"] for r in rows})


def test_shards_of_table_and_corner_rows(mid, mid_rows, odd, empty):
    check_shards(hashtree.shard_documents(mid).collect(), mid_rows)
    check_shards(hashtree.shard_documents(odd).collect(), ODD)
    assert hashtree.shard_documents(empty).count() == 0


def test_shares_follow_weights_and_growth_takes_only_into_the_new_shard(spark):
    keys = spark.range(20_000)
    tree = hashtree.layout(16)
    heavier = [(a, b, c, 3.0 if c == 5 else w) for a, b, c, w in tree]
    df = keys
    for name, t in (("a_", tree), ("b_", heavier), ("c_", hashtree.grown(tree)), ("d_", hashtree.layout(18))):
        df = hashtree.place(df, "id", t, name)
    rows = df.collect()
    share = Counter(r["a_shard"] for r in rows)
    assert max(share.values()) < 1.15 * 1250 and min(share.values()) > 0.85 * 1250
    assert abs(Counter(r["b_shard"] for r in rows)[5] / 20_000 - 3 / 18) < 0.01
    for r in rows:
        # only nodes on the path of the changed weight lose or gain
        if r["a_region"] == r["b_region"] and r["a_region"] != 0:
            assert r["a_shard"] == r["b_shard"]
        if r["a_region"] != r["b_region"]:
            assert r["b_region"] == 0
        assert r["c_shard"] in (r["a_shard"], 16) and r["d_shard"] in (r["c_shard"], 17)


# chat ---------------------------------------------------------------------
def brute_chats(turns):
    convs = defaultdict(set)
    for c, t, r, x in turns:
        convs[c].add((t is not None, t or 0, r or "", x or ""))
    lists = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    out = []
    for c, v in lists.items():
        same = [k for k, w in lists.items() if w == v]
        if c == min(same, key=lambda k: (k is not None, k or 0)) and not any(len(w) > len(v) and w[:len(v)] == v for w in lists.values()):
            for b in range(0, len(v), chat.BLOCK_TURNS):
                out.append((c, b // chat.BLOCK_TURNS, len(v), len(same),
                            "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v[b:b + chat.BLOCK_TURNS])))
    return sorted(out, key=str)


def test_chats_against_brute_force(spark):
    r = random.Random(2)
    turns = []
    bases = [[(r.choice(["user", "assistant"]), f"text {r.randrange(5)}") for _ in range(r.randrange(1, 9))] for _ in range(12)]
    for c in range(60):
        for i, (role, text) in enumerate(r.choice(bases)[:r.randrange(1, 9)]):
            turns.append((c, i, role, text))
    turns += turns[:20] + [(None, 0, "user", "no id"), (70, None, None, None), (70, 1, "user", ""), (71, 1, "b", "tie"), (71, 1, "a", "tie")]
    turns += [(80, i, "user", f"long {i}") for i in range(600)] + [(81, i, "user", f"long {i}") for i in range(599)]
    frame = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, position int").repartition(5)
    assert sorted(map(tuple, chat.format_chats(frame).collect()), key=str) == brute_chats(turns)
    assert chat.format_chats(frame.where("conv_id < 0")).count() == 0


def test_chats_equal_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    got = queries.QUERIES["op6_chat"](spark, "/root/testdata/sf0.01")
    want = con.sql(f"SELECT conv_id, block, n_turns, copies, rendered FROM ({queries.ORACLE['op6_chat']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


# toxicity -----------------------------------------------------------------
def grams(text):
    import re
    out = set()
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        w = f" {w} "
        out |= {w[i:i + n] for n in toxicity.ORDERS for i in range(len(w) - n + 1)}
    return out


def test_features_are_the_distinct_character_ngrams():
    texts = ["The cat, the CAT!", None, "", "a", "émile naïve", "x" * 300]
    text, feature = toxicity.Features().of(pa.array(texts))
    for i, t in enumerate(texts):
        assert (text == i).sum() == len(grams(t))
    known = toxicity.Features()
    known.of(pa.array(["other words first"]))
    again = known.of(pa.array(texts))
    assert (again[0] == text).all() and (again[1] == feature).all()


def test_held_out_documents_are_told_apart(spark, mid):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = toxicity.classify(docs, labels)
    rows = got.join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows)
    bad, good = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert np.mean(np.array(bad) >= 0.7) > 0.7 and np.mean(np.array(good) < 0.7) > 0.97
    # chance that a toxic document scores above a clean one
    assert np.mean([np.mean(np.array(good) < b) for b in bad]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_toxicity_corner_rows(spark, odd, empty):
    labels = spark.createDataFrame([(10, 1), (11, 0), (12, None), (None, 1), (8, 0), (8, 1)], "doc_id long, toxic int")
    rows = toxicity.classify(odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (7, 8, 9)}) == 1
    assert toxicity.classify(odd, labels.where("doc_id < 0")).count() == len(ODD)
    assert toxicity.classify(empty, labels).count() == 0
    kept = toxicity.keep_clean(odd, labels)
    assert kept.schema == odd.schema
    assert kept.where(F.col("doc_id").isNull()).count() == 1


def test_a_conversation_named_null_is_not_the_missing_one(spark):
    from wardlens.llm import chat
    df = spark.createDataFrame([("null", 1, "user", "one"), (None, 1, "user", "two")], "conv_id string, turn long, role string, text string")
    assert [r["n_turns"] for r in chat.format_chats(df).collect()] == [1, 1]
