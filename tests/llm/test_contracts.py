"""The numbered queries against plain Python that follows their definitions, over whole small tables with hard cases added."""

import hashlib
import math
import re
import shutil
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pandas as pd
import pytest

from leafmill.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lorem vel " * 4000 + "password = correcthorse99 AKIA" + "Q" * 18
ADDED = [
    None, "", " \n\t ", "one", "a b", "A B", "The MIT License and the Apache License: GNU General Public License, CC-BY", LONG, LONG,
    "token: 'deadbeefdeadbeefdeadbeef' secret=abc api_key = 12345x", "xé İ \U0001f600 password=é", "mit license mit license", "a a a a a a a", "q w e r t y\nq w e r t y\n\nq w e r t y",
    "a \u2581 changed", "<0x41> <s> </s> <|endoftext|> <unk>", "tab\tand\x00 \U0001f468\u200d\U0001f469 \u00e9e\u0301   ", "\n\n  \n", "0123456789" * 90,
]


def lower(text):
    return (text or "").translate(LOWER)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    for path in Path("/root/testdata/sf0.001").glob("*.parquet"):
        shutil.copyfile(path, out / path.name)
    docs = pd.read_parquet(out / "documents.parquet")
    more = pd.DataFrame({"doc_id": range(10**6, 10**6 + len(ADDED)), "text": ADDED}).reindex(columns=docs.columns)
    more["n_chars"] = 0
    pd.concat([docs, more], ignore_index=True).astype(docs.dtypes.to_dict()).to_parquet(out / "documents.parquet")
    pages = pd.read_parquet(out / "pages.parquet")
    urls = [None, "", "no-scheme.org/x", "http://", "HTTP://A.Example.ORG/en/1", "https://example.org/es/x?y", "http://x.fr?q", "http://b.com/de/z#f", "http://b.com/den", "http://org", "http://myexample.org/es/", "http://x.com/fr/"]
    more = pd.DataFrame({"page_id": range(10**6, 10**6 + len(urls)), "url": urls}).reindex(columns=pages.columns)
    pd.concat([pages, more], ignore_index=True).astype(pages.dtypes.to_dict()).to_parquet(out / "pages.parquet")
    return str(out)


@pytest.fixture(scope="module")
def docs(folder):
    table = pd.read_parquet(f"{folder}/documents.parquet")
    return {int(i): t if isinstance(t, str) else None for i, t in zip(table.doc_id, table.text)}


@pytest.fixture(scope="module")
def result(spark, folder):
    made = {}

    def of(name):
        if name not in made:
            made[name] = [r.asDict() for r in QUERIES[name](spark, folder).collect()]
        return made[name]

    return of


def by_doc(rows, docs):
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    return {r["doc_id"]: r for r in rows}


def test_op1_license_scans(result, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rows = by_doc(result("op1_license_scans"), docs)
    for i, text in docs.items():
        words, r = WORD.findall(lower(text)), rows[i]
        at = [(k, label) for p, label in phrases.items() for n in [len(p.split())] for k in range(len(words) - n + 1) if words[k : k + n] == p.split()]
        labels = sorted({label for _, label in at})
        starts = [k for k, _ in at]
        want = (len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(labels))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == want, i
        found = r["labels"].split(",") if r["labels"] else []
        assert set(labels) <= set(found) and found == sorted(set(found)) and 0 <= r["score"] <= 1


def test_op2_packing(result, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in result("op2_packing"):
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(docs)
    total = 0
    for i, text in docs.items():
        ids, at = [*coder.encode(text or "", add_special_tokens=False).ids, 2], 0
        total += len(ids)
        parts = sorted(pieces[i], key=lambda r: r["piece"])
        assert len(parts) == -(-len(ids) // 1024)
        for k, r in enumerate(parts):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == 1024 or k == 0
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{r['length']}I", *ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(places) <= math.ceil(total / 1024) * 1.02 + 1


def test_op3_url_filters(result, folder):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    pages = pd.read_parquet(f"{folder}/pages.parquet")
    rows = {r["page_id"]: r for r in result("op3_url_filters")}
    assert len(rows) == len(pages)
    for i, url in zip(pages.page_id, pages.url):
        rest = url.split("://", 1)[1] if isinstance(url, str) and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(LOWER)
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None), url
        assert r["verdict"] in ("allow", "block") and (not fits or r["verdict"] == max(fits)[2])


def test_op4_chat_formatting(result, folder):
    rows = result("op4_chat_formatting")
    assert rows and len({r["conv_id"] for r in rows}) == len(rows)
    for r in rows:
        assert r["prompt"] is not None and r["n_prompt_turns"] >= 0


def test_op5_lm_scoring(result, docs):
    rows = by_doc(result("op5_lm_scoring"), docs)
    tokens = {i: [*SOLID.findall(lower(t)), None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        r = rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_op6_secret_scans(result, docs):
    kinds = {
        "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
        "access": re.compile(r"AKIA[A-Z0-9]+"),
        "hex": re.compile(r"[0-9a-f]+"),
    }
    fits = {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}
    rows = by_doc(result("op6_secret_scans"), docs)
    for i, text in docs.items():
        spans = {k: [m.span() for m in p.finditer(text or "") if fits[k](m)] for k, p in kinds.items()}
        base = sorted((s, list(kinds).index(k), f"{k}:{s}:{e}") for k, found in spans.items() for s, e in found)
        r = rows[i]
        assert [r[f"n_{k}"] for k in kinds] == [len(spans[k]) for k in kinds], i
        assert r["base_sha256"] == sha(",".join(b for *_, b in base)), i
        assert {b for *_, b in base} <= set(r["spans"].split(","))


def test_op7_decontamination(result, docs, folder):
    items = pd.read_parquet(f"{folder}/benchmark.parquet")
    windows = defaultdict(set)
    for item, text in zip(items.item_id, items.text):
        words = WORD.findall(lower(text))
        for k in range(max(len(words) - 9, 1 if words else 0)):
            windows[tuple(words[k : k + 10])].add(str(item))
    sizes = {len(w) for w in windows}
    rows = by_doc(result("op7_decontamination"), docs)
    for i, text in docs.items():
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w]
        r = rows[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(words), len(hit), len(found), bool(hit)), i
        assert r["items_sha256"] == sha(",".join(sorted(found)))


def test_op8_substring_dedup(result, docs):
    rows, seen = by_doc(result("op8_substring_dedup"), docs), set()
    for i in sorted(docs):
        words, gone = SOLID.findall(docs[i] or ""), set()
        for k in range(len(words) - 19):
            if (w := tuple(words[k : k + 20])) in seen:
                gone.update(range(k, k + 20))
            seen.add(w)
        r = rows[i]
        assert (r["n_words"], r["n_removed"]) == (len(words), len(gone)), i
        assert r["kept_sha256"] == sha(" ".join(w for k, w in enumerate(words) if k not in gone)), i


def test_op9_quality_rules(result, docs):
    rows = by_doc(result("op9_quality_rules"), docs)
    for i, text in docs.items():
        text = text or ""
        words, lines = SOLID.findall(text), [x for x in text.split("\n") if SOLID.search(x)]
        grams = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        repeated = {k + j for k in range(len(words) - 2) if grams[tuple(words[k : k + 3])] > 1 for j in range(3)}
        r = rows[i]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, i
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_op10_minhash_dedup(result, docs):
    rows, sets = by_doc(result("op10_minhash_dedup"), docs), {}
    for i, text in docs.items():
        words = SOLID.findall(lower(text))
        sets[i] = {tuple(words[k : k + 2]) for k in range(max(len(words) - 1, 1))} if words else set()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(i for i in docs if sets[i])
    for x, a in enumerate(order):
        for b in order[x + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= 80 * large:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    lo, hi = sorted((find(a), find(b)))
                    root[hi] = lo
    for i in docs:
        assert (rows[i]["n_shingles"], rows[i]["component_id"], rows[i]["kept"]) == (len(sets[i]), find(i), find(i) == i), i


def test_op11_source_divergence(result, folder):
    from compared import oracle_rows, rows_of

    from leafmill.llm.queries import ORACLE_SQL

    rows = result("op11_source_divergence")
    columns = list(rows[0])
    assert (sorted(columns), rows_of(columns, [[r[c] for c in columns] for r in rows])) == oracle_rows(ORACLE_SQL["op11_source_divergence"], folder)


def tokens_of(text, coder, pieces):
    """Ids and bytes of both sides, or nothing where one changes the text."""
    if not text:
        return [], []
    letters = {}
    for b in range(256):
        letters[chr(b) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b else chr(256 + len([x for x in range(b) if not (0x21 <= x <= 0x7E or 0xA1 <= x <= 0xAC or 0xAE <= x)]))] = b
    got = coder.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(letters[c] for c in t)) for i, t in zip(got.ids, got.tokens)]
    b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i in pieces.encode(text) for p in [pieces.id_to_piece(i)]]
    want = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in side) == want for side in (a, b)) else ([], [])


def spans_of(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def test_op13_tokenizer_alignment(result, docs):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows, links, spelled, sizes, counts = by_doc(result("op13_tokenizer_alignment"), docs), {}, {}, {}, Counter()
    for i, text in docs.items():
        a, b = map(spans_of, tokens_of(text, coder, pieces))
        begin, found = 0, []
        for x, s, e in a:  # b is sorted: those before begin end too early
            while begin < len(b) and b[begin][2] <= s:
                begin += 1
            k = begin
            while k < len(b) and b[k][1] < e:
                found.append((x, b[k][0]))
                k += 1
        links[i], sizes[i] = found, (len(a), len(b))
        counts.update(found)
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        spelled[i] = ";".join("|".join(",".join(str(x) for x, _, e in side if lo < e <= hi) for side in (a, b)) for lo, hi in zip([0, *ends], ends))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    for i in docs:
        want = (*sizes[i], spelled[i].count("|") if spelled[i] else 0, len(links[i]), sum(counts[x] == best[x[1]] for x in links[i]), sum(counts[x] for x in links[i]), sha(spelled[i]) if spelled[i] else "")
        r = rows[i]
        assert tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == want, i
    assert any(t and not sizes[i][0] for i, t in docs.items())  # a text that a tokenizer changes


def test_op12_suffix_array_dedup(result, docs):
    data = {i: (t or "").encode() for i, t in docs.items()}
    seen = Counter(d[k : k + 400] for d in data.values() for k in range(len(d) - 399))
    rows = by_doc(result("op12_suffix_array_dedup"), docs)
    for i, d in data.items():
        gone = bytearray(len(d))
        for k in range(len(d) - 399):
            if seen[d[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        kept = bytes(b for b, g in zip(d, gone) if not g)
        want = (len(d), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
        assert tuple(rows[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want, i
    assert sum(r["n_removed"] for r in rows.values()) > 10_000
