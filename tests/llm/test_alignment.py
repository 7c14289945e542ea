"""Token alignment against both tokenizers on whole texts, with sets of bytes instead of matrices."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.dataset
import pytest
import sentencepiece
from tokenizers import Tokenizer

import small
from sitewise.llm import alignment, tokens

ODD = ["", None, " ", "  ", "a ", " a", "a  b", "\n", "a\n b \n\nc", "tab\t x", "  nb 　 x", "▁x ▁", "<0x41> <s> </s><unk>", "a\x00b",
       "<|endoftext|> x<|endoftext|>", "don't we'll I'm 's", "\x1c \x1d a\x85 b", "᠎ a ​ b", "é ﬁ Å 🎉👩‍👩‍👧 漢字 ไทย", "\r\n \r x",
       "ab" * 4000, " " * 300 + "x" + "\n" * 50, "1234567 89", "   x y", "﻿a b"]


def rows() -> list[tuple]:
    every = small.repeated()
    return every + [(900 + i, t, *every[0][2:]) for i, t in enumerate(ODD)]


def brute(table: list[tuple]) -> list[tuple]:
    a = Tokenizer.from_file(tokens.vocabulary())
    a.encode_special_tokens = True
    byte_of = tokens._byte_of()
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.piece_vocabulary())

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    docs = []
    for doc, text, *_ in table:
        ids = ([], [])
        if text:
            ids = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
            raw = [[bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]], [piece(i) for i in ids[1]]]
            if any(b"".join(r) != (" " + text).encode() for r in raw):
                ids = ([], [])
        if not ids[0]:
            docs.append((doc, [], [], [], 0, ""))
            continue
        at = [np.repeat(np.arange(len(r)), [len(t) for t in r]) for r in raw]           # the token of every byte
        links = sorted(set(zip(at[0].tolist(), at[1].tolist())))
        ends = [set(np.cumsum([len(t) for t in r]).tolist()) for r in raw]
        cuts = sorted(ends[0] & ends[1])
        groups, inner, low = [], 0, 0
        for cut in cuts:
            sides = [sorted(set(x[low:cut].tolist())) for x in at]
            groups.append("|".join(",".join(str(i[t]) for t in side) for i, side in zip(ids, sides)))
            inner += len(sides[0]) * len(sides[1])
            low = cut
        docs.append((doc, ids[0], ids[1], [(ids[0][i], ids[1][j]) for i, j in links], inner, ";".join(groups)))
    count = Counter(p for d in docs for p in set(d[3]))
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(d, len(x), len(y), s.count("|"), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(s.encode()).hexdigest() if s else "", inner) for d, x, y, links, inner, s in docs]


def order(table):
    return sorted(table, key=lambda r: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r))


@pytest.mark.parametrize("size,pairs", [(8 << 20, 50_000), (2000, 100)])
def test_equals_brute_force(spark, monkeypatch, size, pairs):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", size)
    monkeypatch.setattr(alignment, "RANGE_PAIRS", pairs)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", size)
    monkeypatch.setattr(alignment, "UNITS_AT_ONCE", size)
    got = alignment.align_documents(spark.createDataFrame(rows(), small.SCHEMA).repartition(3))
    assert order(tuple(r) for r in got.collect()) == order(brute(rows()))


def test_empty_table(spark):
    got = alignment.align_documents(spark.createDataFrame([], small.SCHEMA))
    assert got.count() == 0 and got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_units_join_to_whole_texts():
    rng = random.Random(9)
    both = alignment.tokens_of(tokens.vocabulary(), alignment.piece_vocabulary())
    whole = Tokenizer.from_file(tokens.vocabulary())
    whole.encode_special_tokens = True
    for _ in range(3000):
        text = "".join(rng.choice(" \t\n\r'sa1.é漢  ᠎\x1c\x85　_́") for _ in range(rng.randrange(1, 14)))
        cut = alignment.units(text)
        assert " " + " ".join(cut) == " " + text
        assert [i for u in cut for i in both.a.encode_ordinary(" " + u)] == whole.encode(" " + text, add_special_tokens=False).ids
        assert [i for u in cut for i in (both.b.encode(u) if u else [both.b.piece_to_id("▁")])] == both.b.encode(text)


def test_products_equal_dense():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (rng.random(s) < 0.3 for s in ((7, 11), (11, 5)))
        sparse = [alignment.Csr(np.r_[0, np.cumsum(m.sum(1))], np.nonzero(m)[1]) for m in (a, b)]
        got = alignment.products(*sparse, block=int(rng.integers(1, 40)))
        dense = np.zeros((7, 5), int)
        dense[np.repeat(np.arange(7), got.row_sizes()), got.index] = got.value
        assert (dense == a.astype(int) @ b.astype(int)).all() and (got.value > 0).all()
        assert (alignment.product_sizes(*sparse) == dense.sum(1)).all()


def test_a_long_text():
    text = " ".join(small.words(random.Random(1), 400_000, small.LETTERS["en"]))
    both = alignment.tokens_of(tokens.vocabulary(), alignment.piece_vocabulary())
    cut = [*sorted(set(alignment.units(text))), "q" * 300_000, "x  y"]
    rank, found = both.learn(cut)
    assert found.sound.all() and len(found.texts) == len(found.figures) == len(cut) and found.figures[:, 3].sum() == len(found.pairs)
    alone = both.align(["x  y"])
    assert found.texts[rank[-1]] == alone.texts[0] and (found.figures[rank[-1]] == alone.figures[0]).all()


def test_rows_and_row_groups_of_chunks_stay_small(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(small.words(rng, 1500, small.LETTERS["en"])) for _ in range(400)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert sum(map(len, texts)) > 3 << 20
    kept = []
    monkeypatch.setattr(alignment, "discard", lambda _, path: kept.append(path))
    monkeypatch.setitem(alignment.LARGE_ROWS, "parquet.block.size", str(1 << 20))
    assert alignment.align_documents(table).count() == len(texts)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(16 << 20)
    stored = pyarrow.dataset.dataset(next(p for p in kept if "alignment-chunks" in p).removeprefix("file:"), format="parquet")
    rows = stored.to_table()
    # what a task holds: rows of a chunk, and the rows of a row group, which are read at once
    sizes = [sum(len(rows.column(c)[i].as_py()) for c in ("keys", "times", "unit_sizes", "unit_at", "text_sizes", "text_at")) for i in range(rows.num_rows)]
    assert rows.num_rows >= 3 and max(sizes) < 2 << 20
    groups = [f.metadata.row_group(i) for f in stored.get_fragments() for i in range(f.metadata.num_row_groups)]
    assert max(g.total_byte_size for g in groups) < 3 << 20 and len(groups) > 1


def test_chunks_ask_together(spark, monkeypatch):
    table = spark.createDataFrame(rows(), small.SCHEMA).coalesce(1)
    expected = order(brute(rows()))
    for chunk, asked, pairs in ((500, 300, 60), (500, 1 << 20, 60), (3000, 4000, 50_000)):
        for name, value in (("CHUNK_BYTES", chunk), ("ASKED_BYTES", asked), ("RANGE_PAIRS", pairs), ("BATCH_BYTES", 5000)):
            monkeypatch.setattr(alignment, name, value)
        assert order(tuple(r) for r in alignment.align_documents(table).collect()) == expected


def test_narrow_numbers():
    for top, size in ((0, 1), (255, 1), (256, 2), (65_535, 2), (65_536, 4), (1 << 32, 8)):
        raw = alignment.narrow(np.array([0, top, 3], np.int64))
        assert raw[0] == size and len(raw) == 1 + 3 * size and alignment.widened(raw).tolist() == [0, top, 3]
    assert alignment.widened(alignment.narrow(np.zeros(0, np.int64))).tolist() == []
