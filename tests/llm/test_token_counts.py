import random

import pytest
from tokenizers import Tokenizer, models

from quillmesh.llm import token_counts as tc


@pytest.fixture(scope="module")
def reference():
    # The public tokenizer needs byte pieces, but matches these and the unknown one as text: no text below holds one.
    pieces = [("<unk>", 0.0), *tc.vocabulary(tc.vocabulary_path()), *((f"<0x{k:02X}>", 0.0) for k in range(256))]
    tokenizer = Tokenizer(models.Unigram(pieces, 0, True))

    def count(text):
        return len(tokenizer.encode(tc.MARK + text.replace(" ", tc.MARK), add_special_tokens=False).ids) if text else 0

    return count


def test_counts_equal_the_unigram_tokenizer(reference):
    rng = random.Random(4)
    own = tc.UnigramCounter(tc.vocabulary(tc.vocabulary_path()), limit=300)
    assert own.cut
    alphabet = list("etaoinshrdlu" * 4 + "bcdfgEAT  \n\t.,;:!?'\"-()0123456789") + ["é", "ß", "中", "😀", "\x00", "▁", "  ", "the", "<s>", "</s>", "ing "]
    texts = ["", " ", "  ", "a", " a ", "\n\n", "hello world", "中文 字", "😀😀"] + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(3000)]
    for text in texts:
        assert own.count(text) == own.viterbi(tc.MARK + text.replace(" ", tc.MARK)) * bool(text) == reference(text), repr(text)


def walked(text, pieces):
    """Pieces of the best path by trying every piece at every place, the one that starts first among equals."""
    scores, unknown = dict(pieces), min(s for _, s in pieces) - tc.PENALTY
    best, count = [0.0] + [None] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 64), end):
            score = scores.get(text[start:end])
            if score is not None and (best[end] is None or best[start] + score > best[end]):
                best[end], count[end] = best[start] + score, count[start] + 1
        if text[end - 1] not in scores:
            if best[end] is None or best[end - 1] + unknown > best[end]:
                best[end], count[end] = best[end - 1] + unknown, count[end - 1] + len(text[end - 1].encode())
    return count[-1]


def test_control_and_byte_pieces_never_match_text():
    pieces = tc.vocabulary(tc.vocabulary_path())
    assert not {"<s>", "</s>", "<unk>", "<0x0A>", "<0xFF>"} & {p for p, _ in pieces}
    own = tc.UnigramCounter(pieces)
    for text in ("a<s>b", "<0x0A>", "x</s><unk>é", "<0xFF><s>\n"):
        assert own.count(text) == walked(tc.MARK + text, pieces) > 3


def test_scores_that_are_no_whole_numbers():
    rng = random.Random(6)
    pieces = [("".join(rng.choices("ab▁c", k=rng.randint(1, 4))), -rng.random() * 10) for _ in range(60)]
    pieces = list(dict(pieces).items())
    own = tc.UnigramCounter(pieces)
    assert not own.cut
    for _ in range(500):
        text = "".join(rng.choices("abcd é", k=rng.randint(1, 40)))
        assert own.count(text) == walked(tc.MARK + text.replace(" ", tc.MARK), pieces)


def test_ties_go_to_the_piece_that_starts_first():
    pieces = [("<unk>", -9.0), ("a", -2.0), ("aa", -4.0), ("aaa", -6.0), ("b", -1.0)] + [(f"<0x{k:02X}>", -8.0) for k in range(256)]
    tokenizer = Tokenizer(models.Unigram(pieces, 0, True))
    own = tc.UnigramCounter(pieces)
    for text in ("a", "aa", "aaa", "aaaa", "aaaaa", "abaab", "cc", "acca", "éa", "aaaaaaaaab" * 3):
        assert own.viterbi(text) == len(tokenizer.encode(text).ids), text


def test_query_nulls_and_empty(spark, sf_dir, reference):
    rows = tc.op2_token_counts(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    assert all(r.n_tokens == reference(texts[r.doc_id] or "") and r.n_chars == len(texts[r.doc_id] or "") for r in rows)
    frame = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (2, "", 3), (3, "x" * 200_000, 4), (3, "x" * 200_000, 4)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or -1, r.n_tokens) for r in tc.token_counts(frame).collect())
    assert got[0] == (-1, reference("a b")) and got[1:3] == [(1, 0), (2, 0)] and got[3] == got[4] == (3, reference("x" * 200_000))
    assert tc.token_counts(frame.limit(0)).count() == 0
