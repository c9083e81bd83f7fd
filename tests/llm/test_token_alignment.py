"""The alignment of two tokenizers against plain Python: whole texts tokenized, byte ranges compared one by one."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tallyspark.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "the quick brown fox jumps over the lazy dog", "the quick brown fox", None, "", " ", "  \n\n  x  ", "ends in spaces   ", "don't  stop\n\n now. ok, ,x 　y   z  ", "é ü ß naïve façade ñ", "日本語 テキスト と 漢字", "😀 emoji 😀😀",
    "a ▁ piece mark", "<|endoftext|> <s> <0x41> </s>", "x" * 3000, "the quick brown fox jumps over the lazy dog", "tab\tand\x0bother \x1c spaces \x85 here", "1234567890 3.14 [*]{}", "\0 nul \0", "Grüße an  alle   hier", "ok   em space", "é", "a", "a b",
]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    a_bytes, b_bytes = token_alignment.byte_level(A), token_alignment.pieces(B)
    told, held = [], collections.Counter()
    for i, text in rows:
        groups, links = [], []
        if text:
            a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            raw = (" " + text).encode()
            if a_bytes.joined(np.array(a)) == raw == b_bytes.joined(np.array(b)):
                ends = []
                for ids, v in ((a, a_bytes), (b, b_bytes)):
                    end, own = 0, []
                    for k in ids:
                        own.append((end, end + int(v.length[k]), k))
                        end = own[-1][1]
                    ends.append(own)
                cuts = sorted({e for _, e, _ in ends[0]} & {e for _, e, _ in ends[1]})
                at = [0, 0]
                for c in cuts:
                    parts = []
                    for x, own in enumerate(ends):
                        first = at[x]
                        while at[x] < len(own) and own[at[x]][1] <= c:
                            at[x] += 1
                        parts.append(",".join(str(k) for _, _, k in own[first : at[x]]))
                    groups.append("|".join(parts))
                j = 0
                for s, e, k in ends[0]:
                    while ends[1][j][1] <= s:
                        j += 1
                    i_b = j
                    while i_b < len(ends[1]) and ends[1][i_b][0] < e:
                        links.append((k, ends[1][i_b][2]))
                        i_b += 1
        told.append((i, len(a) if groups else 0, len(b) if groups else 0, groups, links))
        held.update(set(links))
    most = collections.Counter()
    for (k, _), n in held.items():
        most[k] = max(most[k], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return collections.Counter((i, n, m, len(g), len(x), sum(held[p] == most[p[0]] for p in x), sum(held[p] for p in x), sha(g)) for i, n, m, g, x in told)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None) for r in rows], "doc_id long, text string, slice int, pairs string, n_best long")


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_alignment_against_plain_python(spark, block):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (3, TEXTS[1]), (3, TEXTS[1])]
    rows += [(100 + k, "".join(rng.choice(["the ", "dog", " ", "é", "\n", "x1", ". ", "日", "ing", " ", "▁"]) for _ in range(rng.randrange(1, 40)))) for k in range(60)]
    rng.shuffle(rows)
    want = brute(rows)
    got = token_alignment.align(frame(spark, rows).repartition(3), A, B, block).collect()
    assert collections.Counter(map(tuple, got)) == want
    zero = {r["doc_id"] for r in got if r["groups_sha256"] == ""}
    assert {2, 3, 11} <= zero and 0 not in zero and 12 not in zero  # null, empty, U+2581; the text of a special token is plain


def test_long_text_and_no_rows(spark):
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("etaoinshrdluéü") for _ in range(rng.randrange(1, 12))) for _ in range(60_000))
    rows = [(1, long), (2, "short one"), (3, long[:1000])]
    assert collections.Counter(map(tuple, token_alignment.align(frame(spark, rows), A, B, 1 << 12).collect())) == brute(rows)
    assert token_alignment.align(frame(spark, [(1, None)]), A, B).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")
    assert token_alignment.align(frame(spark, [(1, "x")]).limit(0), A, B).count() == 0


def test_groups(spark):
    """The groups themselves: ids of both, and where each group ends, in tokens and in bytes."""
    rows = token_alignment.groups(frame(spark, [(1, TEXTS[0]), (2, None), (3, "é ß")]), A, B).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[2][1:] == ([], [], [], [], []) and by[1]["byte_end"][-1] == len(TEXTS[0]) + 1
    a, b = token_alignment.byte_level(A), token_alignment.pieces(B)
    for k, text in ((1, TEXTS[0]), (3, "é ß")):
        r, raw, at = by[k], (" " + text).encode(), (0, 0, 0)
        for to in zip(r["a_end"], r["b_end"], r["byte_end"], strict=True):
            part = raw[at[2] : to[2]]
            assert a.joined(np.array(r["a_ids"][at[0] : to[0]])) == part == b.joined(np.array(r["b_ids"][at[1] : to[1]]))
            at = to
        assert at == (len(r["a_ids"]), len(r["b_ids"]), len(raw))


def test_bits():
    rng = np.random.default_rng(0)
    members = np.unique(rng.integers(0, 1000, 200))
    bits = token_alignment.Bits.of(members, 1000)
    assert bits.select().tolist() == members.tolist()
    at = np.arange(1001)
    assert bits.rank(at).tolist() == np.searchsorted(members, at).tolist()
    other = token_alignment.Bits.of(np.arange(0, 1000, 3), 1000)
    assert (bits & other).select().tolist() == [m for m in members if m % 3 == 0]


def test_segments_are_as_whole_texts():
    """Segments tokenized together give what whole texts give, also where nothing may be put together."""
    aligner = token_alignment.Aligner(token_alignment.byte_level(A), token_alignment.pieces(B))
    text = pa.array(TEXTS, pa.string())
    which, at, ids, many = aligner.tokens(text)
    for v, own, n in zip(aligner.both, ids, many, strict=True):
        ends = token_alignment.starts(n)
        for k, d in enumerate(which.tolist()):
            assert own[ends[k] : ends[k + 1]].tolist() == list(v.encode([" " + TEXTS[d]])[0])
            assert at[k + 1] - at[k] == len(TEXTS[d].encode()) + 1
