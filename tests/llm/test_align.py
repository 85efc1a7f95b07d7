"""The alignment against tokens, groups and links worked out document by document from the whole texts."""

import hashlib
from collections import Counter, defaultdict

import pytest

from verdictlake.llm import align

ODD = [None, "", " ", "a", "  two  blanks ", "\n\tx\r\n", "é ü ß \x1c z", "あ　い う", "<|endoftext|> <s> </s> <unk> <0x41>", "▁x ▁", "x" * 4000, "🙂🙂 🙂"]


@pytest.fixture(scope="module")
def files():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def tokens(files, text):
    """[(id, begin, end)] of both sides over the bytes of a space and the text, or two empty lists."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=files[1])
    want, sides = b" " + (text or "").encode(), []
    decoder = align.byte_alphabet()
    for ids, spell in (
        (a.encode(" " + (text or ""), add_special_tokens=False).ids, lambda i: bytes(decoder[c] for c in a.id_to_token(i))),
        (b.encode(text or ""), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()),
    ):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(spell(i))))
            at = out[-1][2]
        if not text or b"".join(spell(i) for i in ids) != want:
            return [], []
        sides.append(out)
    return sides


def brute(files, rows):
    found, counts = [], Counter()
    for i, t in rows:
        a, b = tokens(files, t)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(k) for k, s, e in side if before <= s and e <= c) for side in (a, b)))
            before = c
        links = [(x, y) for x, s, e in a for y, p, q in b if max(s, p) < min(e, q)]
        counts.update(set(links))
        found.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return sorted(
        (str(i), na, nb, g, len(links), sha, sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links))
        for i, na, nb, g, links, sha in found
    )


def collected(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_alignment_equals_brute_force(spark, table, prose, files):
    rows = list(enumerate([*ODD, *[prose(30 + k, k) for k in range(12)], prose(40, 3)])) + [(None, prose(30, 1)), (None, None), (3, "a b"), (3, "a b")]
    want = brute(files, rows)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    for block in (align.BLOCK, 300):
        got = align.alignments(table(rows).repartition(3), *files, block=block)
        assert got.columns == columns and collected(got) == want
    assert align.alignments(table(rows).limit(0), *files).count() == 0


def test_texts_cut_into_pieces_have_the_tokens_of_whole_texts(prose, files):
    a, b = align.loaded(align.ByteLevel, files[0]), align.loaded(align.Pieces, files[1])
    texts = [t for t in ODD if t] + [prose(200, 1), "It's  we'll\n\n  the 12345 ...!? ok x \t y", "a \n b\n c  \n\n d"]
    assert a.ranked is not None
    assert a.lists(texts).to_pylist() == [e.ids for e in a.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert b.lists(texts).to_pylist() == b.model.encode(texts)


def test_byte_alphabet_is_whole():
    assert sorted(align.byte_alphabet().values()) == list(range(256))
    assert align.byte_alphabet()["Ġ"] == 0x20 and align.byte_alphabet()["Ċ"] == 0x0A
