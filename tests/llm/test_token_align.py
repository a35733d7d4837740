"""Alignment of two tokenisers against a plain version over bytes."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from colophon.llm import queries, token_align
from .test_whole import texts_of_all_kinds

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, digest string, n long, block int"


def byte_level():
    """The printable stand-ins of the byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def brute(rows):
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of, counts, found = byte_level(), Counter(), []
    for i, text in rows:
        a, b = [], []
        if text:
            a = [(x, bytes(of[c] for c in a_model.id_to_token(x))) for x in a_model.encode(" " + text, add_special_tokens=False).ids]
            for x in b_model.encode(text):
                piece = b_model.id_to_piece(x)
                b.append((x, bytes.fromhex(piece[3:5]) if b_model.is_byte(x) else piece.replace("▁", " ").encode()))
            want = (" " + text).encode()
            if b"".join(p for _, p in a) != want or b"".join(p for _, p in b) != want:
                a, b = [], []
        spans = []
        for side in (a, b):
            at, out = 0, []
            for x, p in side:
                out.append((at, at + len(p), x))
                at += len(p)
            spans.append(out)
        links, j = [], 0
        for lo, hi, x in spans[0]:
            while spans[1][j][1] <= lo:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < hi:
                links.append((x, spans[1][k][2]))
                k += 1
        groups, lo = [], 0
        for end in sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}):
            groups.append("|".join(",".join(str(x) for s, e, x in side if lo <= s and e <= end) for side in spans) if len(a) < 400 else (lo, end))
            lo = end
        if len(a) >= 400:  # the same, in one walk
            at, spelt = [0, 0], []
            for _, end in groups:
                both = []
                for k, side in enumerate(spans):
                    first = at[k]
                    while at[k] < len(side) and side[at[k]][1] <= end:
                        at[k] += 1
                    both.append(",".join(str(x) for _, _, x in side[first : at[k]]))
                spelt.append("|".join(both))
            groups = spelt
        counts.update(links)
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    best = {}
    for (_, y), c in counts.items():
        best[y] = max(best.get(y, 0), c)
    return [(i, na, nb, ng, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), sha) for i, na, nb, ng, ls, sha in found]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("block", [64, 1 << 21])
def test_odd_texts(spark, block):
    texts = texts_of_all_kinds()[:600] + [None, "", " ", "▁", "a▁b", "<s></s><unk><0x0A>", "a\0b", "  x\n\n\t y   ", "日本語", "\U0001f600" * 9, "x" * 5000, "\r\n" * 50, "ﬁ é"]
    rows = list(enumerate(texts)) + [(None, "again"), (5, "again"), (5, "again")] + [(9000 + i, "one text in a third of all rows") for i in range(300)]
    got = token_align.align(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA), block=block).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_empty_table(spark):
    assert token_align.align(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_token_align(spark, SF).collect())) == sorted(brute(rows))


def test_long_text(spark):
    """A text of many blocks' size is one block, in linear time."""
    text = "word and " * 200_000 + " " * 50_000
    got = token_align.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), block=1000).collect()
    assert [tuple(r) for r in got] == brute([(1, text)])
