import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_ten_operators import classes_by_hand, clashing, copies, lines_by_hand, prose, secret_texts, spans_by_hand, unpacked
from tokenizers import Tokenizer

from kilnspark.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "secret_scans", "packing"]
    assert seen[1] == seen[0] and seen[3] == seen[2] < seen[1] and docs.where("length > 2048").count() == 0
    assert docs.select("doc_id").distinct().count() == seen[3]
    assert corpus_pipeline.run(spark, SF).count() == seen[4]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_are_whole(spark, name):
    got = queries.queries()[name](spark, SF)
    if name == "op7_exact_topk":
        assert got.count() == 50
    else:
        assert got.select("doc_id").distinct().count() == 200


def redacted(text):
    out, at = "", 0
    for start, kind, end in spans_by_hand(text)[1]:
        if start >= at:
            out += text[at:start] + f"[{('ASSIGN', 'ACCESS', 'HEX', 'SECRET', 'ENDPOINT')[kind]}]"
        at = max(at, end)
    return out + text[at:]


def test_stages_by_brute_force(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, clashing names, stage by stage."""
    rng = random.Random(16)
    bad = lambda i: i % 5 == 0 and i < 300
    made = [(i, prose(40, rng) + (f" vilestem{rng.choice('abc')} " if bad(i) else " ") + prose(20, rng)) for i in range(300)]
    made += enumerate(copies(rng, 12), 300)
    made += enumerate(("A line that many hold.\n" + prose(15, rng) + "\n a LINE that many hold. " for _ in range(20)), 320)
    made += enumerate(secret_texts(rng, 60), 340)
    made += [(500, None), (501, ""), (502, prose(9000, rng)), (502, prose(9000, rng)), (503, "x" * 40_000), made[301], made[301], (None, prose(30, rng)), (None, None)]
    docs = clashing(spark.createDataFrame(made, "doc_id long, text string")).selectExpr("*", "length(text) as n_chars")
    folder = str(tmp_path)
    spark.createDataFrame([(i, int(bad(i))) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        given, got = rows(before), Counter(map(tuple, docs.select("doc_id", "text").collect())) if name != "packing" else None
        full = [(i, t or "") for i, t in given]
        if name == "toxicity":
            assert got == Counter((i, t) for i, t in given if i is None or not bad(i))
        elif name == "line_dedup":
            want = Counter()
            for (i, _, _, kept), n in lines_by_hand(full).items():
                want[i, kept] += n
            assert Counter((i, t or "") for i, t in got.elements()) == want
            assert sum(t is None for _, t in got.elements()) == sum(t is None for _, t in given)
        elif name == "near_duplicates":
            named = [(i, t) for i, t in full if i is not None]
            first = {c for _, c in classes_by_hand(named)}
            assert {i for i, _ in got if i is not None} == first and not got - Counter(given)
            assert sum(n for (i, _), n in got.items() if i is None) == 2
            assert len(classes_by_hand([(i, t or "") for i, t in got.elements() if i is not None])) == sum(i is not None for i, _ in got.elements()) - 1
        elif name == "secret_scans":
            assert got == Counter((i, t if t is None else redacted(t)) for i, t in given)
        else:
            packed = docs.collect()
            unpacked(packed, 2048)
            want = Counter()
            for i, t in full:
                ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
                cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    want[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
        if name != "packing":
            assert docs.columns == before.columns and docs.where("n_chars <> length(text)").count() == 0


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
