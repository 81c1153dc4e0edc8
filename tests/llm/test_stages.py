"""Each stage of the pipeline against plain Python, on the documents that the stage before kept and some hard ones."""

import re
import zlib
from collections import Counter

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from leafmill.llm import quality
from leafmill.llm.secrets import LEAST_COST, find_spans, known_words

FOLDER = "/root/testdata/sf0.001"
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)


@pytest.fixture(scope="module")
def stages(spark):
    """By name of a stage: the (doc_id, text) that it is given and what it gives, with extra rows ahead of the first one."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    long = docs.orderBy("n_chars", ascending=False).first()["text"]
    added = [(10**6, long), (10**6 + 1, long + " one more line"), (10**6 + 2, None), (10**6 + 3, ""), (10**6 + 4, long[: len(long) // 2]), (10**6 + 5, "key " + long + " password = Xk29vQpL77tz")]
    more = spark.createDataFrame(added, "doc_id long, text string")
    docs, out = docs.unionByName(more, allowMissingColumns=True).select(*docs.columns), {}
    for name, stage in pipeline.STAGES[:-1]:
        given = docs
        docs = pipeline.stored(stage(spark, docs, FOLDER), name)
        out[name] = tuple({r["doc_id"]: r["text"] for r in d.select("doc_id", "text").collect()} for d in (given, docs))
    name, stage = pipeline.STAGES[-1]
    out[name] = ({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}, stage(spark, docs, FOLDER).collect())
    out["rules"] = quality.learn_rules(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    return out


def test_quality_rules(stages):
    given, kept = stages["quality_rules"]
    for i, text in given.items():
        words, lines = SOLID.findall(text or ""), [x for x in (text or "").split("\n") if SOLID.search(x)]
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = len({k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)})
        bad = len(words) < 50 or 100 * repeated > 50 * len(words)
        if not bad:
            share = {"symbol_share": len(re.findall(r"[#*$%&|<>]", text)) / len(words), "dup_line_share": (len(lines) - len(set(lines))) / len(lines), "repeat_share": repeated / len(words)}
            for rule in stages["rules"]:
                if all(quality.FEATURES[t.feature] in share for t in rule):
                    bad = bad or all((share[quality.FEATURES[t.feature]] > t.at) == t.above for t in rule)
        assert not (bad and i in kept), i
    assert all(kept[i] == given[i] for i in kept) and len(kept) > len(given) / 2


def test_near_dedup(stages):
    given, kept = stages["near_dedup"]
    sets = {}
    for i, text in given.items():
        w = SOLID.findall(lower(text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in given}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(given)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(kept) == {i for i in ids if find(i) == i or not sets[i]}


def test_benchmark_decontamination(stages, spark):
    given, kept = stages["benchmark_decontamination"]
    runs = set()
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        w = ALNUM.findall(lower(r["text"] or ""))
        runs |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(r) for r in runs}
    for i, text in given.items():
        w = ALNUM.findall(lower(text or ""))
        hit = any(tuple(w[k : k + n]) in runs for n in sizes for k in range(len(w) - n + 1))
        assert (i in kept) == (not hit), i


def test_secret_scans(stages):
    given, kept = stages["secret_scans"]
    assert set(given) == set(kept)
    words = known_words()
    for i, text in given.items():
        spans, want, at = find_spans(text or "", LEAST_COST, words), "", 0
        inside = bytearray(len(text or ""))
        for a, _, b in spans:
            inside[a:b] = b"\1" * (b - a)
        while spans and at < len(text):
            n = 1
            if inside[at]:
                while at + n < len(text) and inside[at + n] and at + n not in {a for a, _, b in spans if all(not (x < a < y) for x, _, y in spans)}:
                    n += 1
                want += "[SECRET]"
            else:
                want += text[at]
            at += n
        assert kept[i] == (want if spans else text), i


def test_best_fit_packing(stages):
    given, rows = stages["best_fit_packing"]
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(given)
    total = 0
    for i, found in pieces.items():
        ids = [*tokenizer.encode(given[i] or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        found.sort(key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(found):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r["length"]])
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, zlib.crc32(raw)) and 0 < r["length"] <= 1024
            assert r["length"] == 1024 or k == 0 or k == len(found) - 1
            at += r["length"]
        assert at == len(ids) and len(found) == -(-len(ids) // 1024)
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= -(-total // 1024) * 1.05 + 1
