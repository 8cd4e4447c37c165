"""Each stage of the pipeline against a plain version over the same input."""

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as C
from scholiast.llm import quality_fm
from scholiast.llm.common import stored

from .test_dedup import brute_bytes
from .test_near_sets import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    schema = docs.select(*C.COLUMNS).schema
    seen = {}
    for name, stage in C.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        seen[name] = (before, docs)
        if name != "tokens":
            assert docs.schema.simpleString() == schema.simpleString()
    before, after = seen["quality"]
    model = quality_fm.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["doc_id"] for r in quality_fm.score(before, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in after.collect()} == kept
    before, after = seen["repeated_bytes"]
    want = brute_bytes([(r["doc_id"], r["text"]) for r in before.collect()])
    assert before.count() == after.count()
    assert all(len(r["text"].encode()) in range(want[r["doc_id"]][0] - want[r["doc_id"]][1] - 8, want[r["doc_id"]][0] - want[r["doc_id"]][1] + 1) and r["n_chars"] == len(r["text"]) for r in after.collect())
    assert seen["tokens"][1].where("NOT exact").count() == 0 and seen["tokens"][1].count() == seen["benchmark"][1].count()


def brute_spans(rows, size=200):
    """Texts without the bytes that a repeated string of that many bytes covers; a character that a cut split goes."""
    c = Counter()
    for _, t in rows:
        b = (t or "").encode()
        c.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if c[b[i : i + size]] > 1:
                gone[i : i + size] = True
        out.append((d, np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return out


def brute_contaminated(rows, items, window=13, share=20):
    """Whether windows of the items cover a twentieth of each text's words."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wanted = {tuple(w[i : i + window]) for w in map(cut, items) if w for i in range(max(1, len(w) - window + 1))}
    out = []
    for t in rows:
        w = cut(t)
        hit = {i + j for n in {len(x) for x in wanted} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in wanted for j in range(n)}
        out.append(bool(hit) and share * len(hit) >= len(w))
    return out


def test_run_equals_brute_force(spark):
    """run() row by row: what brute force leaves of each stage's input, then the library's tokens. The classifier's own score decides the first stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*C.COLUMNS)
    model = quality_fm.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality_fm.score(docs, model).where("predicted = 1").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good)
    groups = brute_groups([t for _, t in rows])
    rows = [x for i, x in enumerate(rows) if groups[i] == i]
    cut = brute_spans(rows)
    flags = brute_contaminated([t for _, t in cut], [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: (len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for (d, t), bad in zip(cut, flags) if not bad}
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in C.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < docs.count()


def test_one_of_each_group_stays(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(5, t, "en", "a", 1), (3, t, "en", "b", 1), (3, t, "en", "b", 1), (9, "quite another text that nobody copied", "en", "c", 1), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in C.near_dedup(spark, docs, SF).collect()) == [2, 3, 9]


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text IS NOT NULL").first()["text"]
    texts = [f"text number {i} says " + " ".join(f"v{i}{k}" for k in range(30)) for i in range(4)]
    rows = [(None, texts[0], "en", "a", 1), (None, texts[1], "en", "a", 1), (7, texts[2], None, "a", 1), (7, texts[3], "a", None, 1), (7, texts[3], "a", None, 1), (7, item, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["text"] for r in C.near_dedup(spark, docs, SF).collect()) == sorted([*texts, item])
    assert sorted(r["text"] for r in C.benchmark(spark, docs, SF).collect()) == sorted([*texts, texts[3]])
