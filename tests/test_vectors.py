"""Nearest vectors by tiles, against all pairs: ties, nulls, zeros, other sizes, and more tiles than rows."""

import numpy as np
import pytest

from leafmill.operators.vectors import cosine_topk, embed_text


@pytest.mark.parametrize(("asked_rows", "tile_rows"), [(1024, 8192), (2, 7)])
def test_tiles_find_what_all_pairs_do(spark, asked_rows, tile_rows):
    rnd = np.random.default_rng(4)
    vectors = {i: rnd.normal(size=8).round(3).tolist() for i in range(60)} | {60: None, 61: [0.0] * 8, 62: [1.0, None] + [0.0] * 6, 63: [1.0, 2.0]}
    vectors[7] = vectors[3]
    queries = {100: vectors[3], 101: rnd.normal(size=8).tolist(), 102: [2.0, 1.0], 103: None, 104: [0.0] * 8, 105: vectors[9]}
    frame = lambda x, name: spark.createDataFrame(list(x.items()), f"{name} long, embedding array<double>")
    got = cosine_topk(frame(vectors, "vec_id"), frame(queries, "query_id"), k=5, least=0.1, asked_rows=asked_rows, tile_rows=tile_rows).collect()
    want = []
    for q, a in queries.items():
        rows = []
        for i, b in vectors.items():
            if a and b and None not in b and len(a) == len(b) and any(a) and any(b):
                c = float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
                rows += [(-round(c, 6), i)] if c >= 0.1 else []
        want += [(q, i, -c, r + 1) for r, (c, i) in enumerate(sorted(rows)[:5])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert cosine_topk(frame(vectors, "vec_id"), frame(queries, "query_id").limit(0)).collect() == []


def test_embeddings_are_masked_means_at_length_one(spark):
    def letters_encoder():
        """A fixed linear encoder: a token is a letter, its vector a row of a matrix."""
        matrix = np.arange(26 * 4, dtype=np.float64).reshape(26, 4) % 7 - 3

        def encode(texts):
            width = max([1, *map(len, texts)])
            codes = np.array([[ord(c) - 97 for c in t] + [-1] * (width - len(t)) for t in texts])
            return matrix[codes], codes >= 0

        return encode

    texts = {1: "abc", 2: "zzzz", 3: "", 4: None, 5: "hello", 6: "a" * 50}
    rows = embed_text(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2), "doc_id", letters_encoder, "letters", batch=2).collect()
    assert len(rows) == len(texts) and {r["model"] for r in rows} == {"letters"}
    for r in rows:
        text = texts[r["doc_id"]] or ""
        vectors, mask = letters_encoder()([text])
        mean = vectors[0][mask[0]].mean(axis=0) if text else np.zeros(4)
        assert np.allclose(r["embedding"], mean / max(np.linalg.norm(mean), 1e-12), atol=1e-6)
