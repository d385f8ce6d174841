"""Token alignment against one text at a time, and the perfect hash it counts with."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest

from trapline.llm import alignment
from trapline.llm.perfect_hash import Counts, PerfectHash, shard_of

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """Rows of ``align_documents``: whole texts, all overlapping pairs by their byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(os.path.join(alignment.TOKENIZERS, "byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=os.path.join(alignment.TOKENIZERS, "piece_bpe_32k.model"))
    of = alignment.byte_of_character()
    made = []
    for doc_id, text in rows:
        a, b, links, groups = [], [], [], []
        if text:
            e = first.encode(" " + text, add_special_tokens=False)
            a = [(i, bytes(of[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
            for i in second.encode(text):
                p = second.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()))
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        last = 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if last <= s and e <= cut) for side in spans))
            links += [(i, j) for i, s, e in spans[0] if last <= s < cut for j, t, f in spans[1] if s < f and t < e]
            last = cut
        made.append((doc_id, len(a), len(b), groups, links))
    count = Counter(p for *_, links in made for p in links)
    best = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    sha = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return [(i, n, m, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), sha(g)) for i, n, m, g, x in made]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


ODD = [
    (1, "A text of words, and a text."), (1, "A text of words, and a text."), (2, None), (3, ""), (4, " "), (5, "  two  spaces \n\n lines\t\ttabs  "), (None, "no id at all"),
    (6, "<|endoftext|> <s> </s> <0x41> <unk>"), (7, "a▁b keeps no space"), (8, "naïve Übermaß 東京 \N{NO-BREAK SPACE} \N{EM SPACE} x 🦊🦊 \x00 \x1f y"), (9, "\n"), (10, "a "),
    (11, "word " * 3000), (12, "x" * 5000), (13, "   lead"), (14, "’s don't they'LL 12345 67,890.5 #$%^&* ---- ...."), (15, "é\N{COMBINING ACUTE ACCENT}é ﬁ Å"),
]


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, None) for i, t in ODD], "doc_id long, text string, shard int").repartition(3)
    assert rows_of(alignment.align_documents(docs)) == sorted(brute(ODD), key=str)


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    assert rows_of(alignment.align_documents(docs)) == sorted(brute([tuple(r) for r in docs.collect()]), key=str)


def test_blocks_vectors_and_pieces(spark, folder, monkeypatch):
    """Small bounds take every branch and change nothing."""
    docs = spark.createDataFrame(ODD * 2 + [(20 + i, f"text {i} of {i % 3} words") for i in range(40)], "doc_id long, text string").repartition(3)
    whole = rows_of(alignment.align_documents(docs))
    for name, value in (("SHARD_KEYS", 200), ("BLOCK_PAIRS", 500), ("VECTOR_ROWS", 5), ("FAN_IN", 2), ("HELD_PAIRS", 100), ("PIECE_BYTES", 300), ("AT_ONCE", 7)):
        monkeypatch.setattr(alignment, name, value)
    assert rows_of(alignment.align_documents(docs)) == whole


def test_no_rows(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    nothing = alignment.align_documents(spark.createDataFrame([(1, None), (2, "▁")], "doc_id long, text string"))
    assert rows_of(nothing) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
    function = PerfectHash.unpack(PerfectHash.of(keys).pack())
    assert len(function) == len(keys) and sorted(function(keys).tolist()) == list(range(len(keys)))
    by_index = np.empty(len(keys), np.uint64)
    by_index[function(keys)] = keys
    counts = Counts(1, {0: (function.pack(), by_index.tobytes(), np.arange(len(keys)).tobytes())})
    assert (counts(by_index) == np.arange(len(keys))).all()
    others = keys + np.uint64(1)
    others = others[~np.isin(others, keys)]
    assert not counts(others).any()
    assert set(shard_of(keys, 7).tolist()) <= set(range(7))


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.of(np.array([3, 3], np.uint64))
