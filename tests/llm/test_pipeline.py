import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import decontaminate, mixing, quality, simhash, tokenfiles
from tests.llm.data import frame, rows, with_own_names
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_simhash import groups
from gridloom.llm.simhash import fingerprints

HERE = "/root/testdata/sf0.001"


def test_stages_are_what_plain_code_makes_of_them(spark):
    docs = spark.read.parquet(f"{HERE}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "source_mixing", "token_files"]
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        rows = at.collect()
        out = stage(spark, at, HERE)
        if name != "token_files":
            assert out.columns == docs.columns
        got = out.collect()
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.judged(docs).filter("kept").collect()}
            assert {r.doc_id for r in got} == kept and 0 < len(got) < len(rows)
        elif name == "near_duplicates":
            prints = fingerprints([(r.text or "").encode() for r in rows])
            assert sorted(r.doc_id for r in got) == sorted(set(groups([int(x) for x in prints], [r.doc_id for r in rows])))
        elif name == "decontamination":
            bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{HERE}/benchmark.parquet").collect()]
            bad = {x[0] for x in contaminated([tuple(r) for r in rows], bench) if x[-1]}
            assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows if r.doc_id not in bad)
        elif name == "source_mixing":
            takes = {r.doc_id: len(r.positions) for r in mixing.mixed(mixing.sized(at)).collect()}
            assert sorted(r.doc_id for r in got) == sorted(d for d, n in takes.items() for _ in range(n))
        else:
            coder, start, want = Tokenizer.from_file(tokenfiles.default_tokenizer()), 0, []
            for r in sorted(rows, key=lambda r: r.doc_id):
                ids = coder.encode(r.text, add_special_tokens=False).ids + [2]
                want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
                start += len(ids)
            assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
        path = corpus_pipeline.written(out, "test")
        at = path


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{HERE}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_columns_named_as_the_operators_own_come_through(spark):
    docs = with_own_names(frame(spark, [r for r in rows() if r[0] != 67]))
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    for step in (quality.cleaned, lambda d: simhash.deduplicated(spark, d), lambda d: decontaminate.decontaminated(spark, d, bench), mixing.mixture):
        plain = docs.drop(*[c for c in docs.columns if c.startswith("__")])
        got = step(docs)
        assert got.columns == docs.columns and all(r["__key"] == 7 for r in got.collect())
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in step(plain).collect())
