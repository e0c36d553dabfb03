import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillmesh.llm import token_files


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_files.vocabulary_path())


def brute(rows, tokenizer):
    """Documents in order, each encoded whole by the library. rows: in order, where doc_ids tie."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def run(spark, rows, folder, **options):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, path string").repartition(3)
    token_files.write_token_files(frame, f"file://{folder}", **options)
    return sorted(map(tuple, token_files.read_token_files(spark, f"file://{folder}").collect()), key=lambda r: r[1])


TEXTS = ["", None, "  two  spaces ", "it's we'll 'S'd don't", "a\n\n b\t\tc \r\n", "x" * 5000, "1234 12 ½²", "é\xa0ÿ\x85z ", "Привет, мир", "日本語 text", "<|endoftext|> after", "<|", "\x00\x1c\x1d\x1f \x7f", "'", " '", "''s", "a'b İſ"]


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], list(range(2000)), [0, 1 << 40], [k * k for k in range(3000)], [0] * 1500 + [1 << 63], [(1 << 64) - 1] * 3, [0, *[10**6] * 600]])
def test_codes_round_trip(values):
    data = b"abc" + token_files.encode(np.array(values, np.uint64))
    code = token_files.EliasFano(data, 3)
    assert code.values().tolist() == values
    assert [code[i] for i in range(0, len(values), 7)] == values[::7]
    with pytest.raises(IndexError):
        code[len(values)]


def test_codes_are_short():
    rng = np.random.default_rng(0)
    values = np.cumsum(rng.integers(1, 1000, 100_000))
    assert len(token_files.encode(values)) * 8 < 100_000 * (2.2 + np.log2(values[-1] / 100_000))


def test_file_gives_single_documents():
    lengths, doc_ids = [1, 5, 0, 3], [None, -9, 4, 4]
    ids = np.arange(9, dtype="<u2")
    own = token_files.TokenFile(b"".join(token_files.file_bytes(doc_ids, lengths, ids.tobytes(), 2)))
    assert [own.document(k).tolist() for k in range(4)] == [[0], [1, 2, 3, 4, 5], [], [6, 7, 8]]
    assert [own.doc_id(k) for k in range(4)] == doc_ids == own.doc_ids()
    assert [own.at(p) for p in range(9)] == [0, 1, 1, 1, 1, 1, 3, 3, 3]
    far = token_files.TokenFile(b"".join(token_files.file_bytes([-(1 << 63), (1 << 63) - 1], [1, 1], ids[:2].tobytes(), 2)))
    assert far.doc_ids() == [-(1 << 63), (1 << 63) - 1] == [far.doc_id(0), far.doc_id(1)]
    with pytest.raises(ValueError):
        token_files.TokenFile(b"".join(token_files.file_bytes(doc_ids, lengths, ids.tobytes(), 2))[:-1])


def test_ids_are_the_library_s(tokenizer):
    rng = random.Random(3)
    alphabet = [chr(c) for c in range(0x17F)] + list("  \n\n\t''''aabbsstdm019..") * 12
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(4000)]
    for limit in (500_000, 20):
        encoder = token_files.ByteIds(token_files.vocabulary_path(), limit, 3000)
        got = [np.frombuffer(b, encoder.kind).tolist() for b in encoder.many([t or "" for t in texts])]
        assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_round_trip(spark, tokenizer, tmp_path):
    rows = [(k * 3 - 20, t) for k, t in enumerate(TEXTS * 3)] + [(10**15, "far"), (-(10**15), "near")]
    random.Random(1).shuffle(rows)
    for name, options in (("one", {}), ("many", {"file_ids": 40})):
        assert run(spark, rows, tmp_path / name, **options) == brute(rows, tokenizer)
    assert len(list((tmp_path / "many/files").glob("*.ids"))) > 5 and not list((tmp_path / "many/files").glob("*.tmp"))


def test_repeated_rows_and_null_ids(spark, tokenizer, tmp_path):
    rows = [(7, "same text")] * 30 + [(None, "no name")] * 4 + [(8, "b")]
    assert run(spark, rows, tmp_path / "a", file_ids=10) == brute(rows, tokenizer)
    mixed = [(7, "one"), (7, "another, longer"), (None, "x"), (None, "y z")]
    got = run(spark, mixed, tmp_path / "b")
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((r[0] or -1, r[2], r[3]) for r in brute(mixed, tokenizer))
    assert all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False)) and [r[0] for r in got] == [None, None, 7, 7]


def test_writing_again_gives_the_same_files(spark, tmp_path):
    rows = [(k, f"text {k % 5}") for k in range(50)]
    for name in ("a", "b"):
        run(spark, rows, tmp_path / name, file_ids=30)
    read = lambda name: {p.name: p.read_bytes() for p in (tmp_path / name / "files").iterdir() if p.suffix == ".ids"}
    assert read("a") == read("b")


def test_empty(spark, tmp_path):
    assert run(spark, [], tmp_path / "none") == []


def test_query_on_the_table(spark, sf_dir, tokenizer):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, token_files.op13_token_files(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == brute(rows, tokenizer)
