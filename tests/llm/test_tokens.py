import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from cases import corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.packing import SquaresPacker, pack
from quillon.llm.token_orc import read_document, token_rows, with_crc32, write_tokens
from quillon.llm.wordbpe import ChunkEncoder, default_tokenizer, gathered_rows


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_tokenizer())


def whole(tok, text, end):
    return [*tok.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


ENC = ChunkEncoder(default_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aA'sΣσ́  \x1c\x85é1 ½\n\t\r ß<|>endoftx!ǅİ")), max_size=40))
def test_chunks_encode_as_the_whole(text):
    from tokenizers import Tokenizer

    t = test_chunks_encode_as_the_whole.__dict__.setdefault("tok", Tokenizer.from_file(default_tokenizer()))
    assert np.frombuffer(ENC.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_many_texts_encode_as_each(tok):
    texts = [t for _, t in corpus(3, 40)] + ["a, b. c.,. .,", "x\x01y \x01", "İstanbul DİYARBAKIR ok", "ß ẞ ǅ", "  ", "\u00a0a\u2028b", "dz" * 5000, "<|endoftext|>x. Y", "é" * 30 + ".,", "don't 'tis it's"]
    for part in (texts, texts[::-1], texts * 3):
        got, at = [None] * len(part), 0
        for lo, hi, ids, n in ENC.encode_rows(pa.array(map(ENC.plain, part), pa.large_string()), most_words=50):
            assert lo == at and len(ids) == n.sum()
            at = hi
            cuts = np.concatenate(([0], np.cumsum(n)))
            got[lo:hi] = [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        assert got == [tok.encode(t or "", add_special_tokens=False).ids for t in part]


def test_rows_are_put_together():
    batches = [pa.RecordBatch.from_pydict({"i": list(range(k, k + 7)), "t": ["ab" * (j % 4) or None for j in range(7)]}) for k in (0, 7, 14)]
    for most in (1, 5, 13, 1000):
        rows = [(i, t) for table, texts in gathered_rows(iter(batches), 1, most) for i, t in zip(table.column(0).to_pylist(), texts.to_pylist(), strict=True)]
        assert rows == [(i, t or "") for b in batches for i, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]


def test_orc_round_trip(spark, tok):
    rows = corpus()
    path = write_tokens(frame(spark, rows), files=3)
    got = with_crc32(token_rows(spark, path)).orderBy("start").collect()
    ids = [x.doc_id for x in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(ids) == len(rows)
    left, start = [(i, whole(tok, t, 2)) for i, t in rows], 0
    for x in got:
        match = next(k for k, (i, w) in enumerate(left) if i == x.doc_id and crc(w) == x.ids_crc32)
        assert x.start == start and x.n_tokens == len(left[match][1])
        start += len(left.pop(match)[1])
    one = read_document(spark, path, [7]).collect()
    assert [list(x.ids) for x in one] == [whole(tok, dict(rows)[7], 2)]


def fields(data):
    """(number, value) pairs of a protocol buffer message."""
    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i, out = 0, []
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        elif tag & 7 == 2:
            n, i = varint(i)
            value, i = data[i: i + n], i + n
        else:
            n = 8 if tag & 7 == 1 else 4
            value, i = data[i: i + n], i + n
        out.append((tag >> 3, value))
    return out


def orc_stripes(path):
    """For each stripe: rows, kinds of streams of doc_id, encoding of the ids; and the file's row index stride."""
    import zstandard

    data = path.read_bytes()
    ps = dict(fields(data[-1 - data[-1]: -1]))
    assert ps[2] == 5  # zstandard

    def message(raw):
        out, i = b"", 0
        while i < len(raw):
            head = int.from_bytes(raw[i: i + 3], "little")
            part = raw[i + 3: i + 3 + (head >> 1)]
            out += part if head & 1 else zstandard.ZstdDecompressor().decompress(part, max_output_size=1 << 22)
            i += 3 + (head >> 1)
        return fields(out)

    end = len(data) - 1 - data[-1]
    footer = message(data[end - ps[1]: end])
    out = []
    for k, v in footer:
        if k == 3:
            info = dict(fields(v))
            at = info.get(1, 0) + info[2] + info[3]
            tail = message(data[at: at + info[4]])
            streams = [dict(fields(x)) for n, x in tail if n == 1]
            encodings = [dict(fields(x)).get(1, 0) for n, x in tail if n == 2]
            out.append((info[5], {x.get(1, 0) for x in streams if x.get(2, 0) == 1}, encodings[6]))
    return out, dict(footer)[8]


def test_orc_layout(spark, tmp_path):
    rows = [(i, f"text number {i} " + "and so on " * (i % 40)) for i in range(20000)]
    path = write_tokens(frame(spark, rows), str(tmp_path / "o"), files=2, stride=1000, stripe_bytes=1 << 16)
    files = sorted((tmp_path / "o").glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == 20000
    for f in files:
        stripes, stride = orc_stripes(f)
        assert stride == 1000 and len(stripes) > 1  # stripes are read in parallel
        for _, kinds, encoding in stripes:
            assert {6, 8} <= kinds  # row index; Bloom filter
            assert encoding == 2  # second version of run-length encoded integers
    found = read_document(spark, path, [5])
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id, [5])]" in plan or "EqualTo(doc_id,5)" in plan
    # The row index leaves few rows to read.
    assert len(found.collect()) == 1
    executed = found._jdf.queryExecution().executedPlan()
    leaf = executed.collectLeaves().head()
    assert 1 <= leaf.metrics().apply("numOutputRows").value() <= 2000


def test_orc_empty(spark):
    assert token_rows(spark, write_tokens(frame(spark, []))).count() == 0


def check_pieces(rows, want, capacity):
    """Each id lies in one piece, sequences are gapless and hold at most the capacity."""
    by_seq, by_doc = {}, {}
    for x in rows:
        by_seq.setdefault(x.sequence_id, []).append(x)
        by_doc.setdefault((x.doc_id, x.doc_tokens), []).append(x)
    for seq in by_seq.values():
        at = 0
        for x in sorted(seq, key=lambda x: x.offset):
            assert x.offset == at and x.length > 0
            at += x.length
        assert at <= capacity
    assert sum(x.length for x in rows) == sum(map(len, want))
    fills = [sum(x.length for x in seq) for seq in by_seq.values()]
    return sum(0 if f & (f - 1) == 0 else capacity - f for f in fills)


@pytest.mark.parametrize("max_open", [4096, 3])
def test_pack_round_trip(spark, tok, max_open):
    rows = corpus()
    got = pack(frame(spark, rows), capacity=128, max_open=max_open).collect()
    assert check_pieces(got, [whole(tok, t, 1) for _, t in rows], 128) == 0
    texts = {i: whole(tok, t, 1) for i, t in rows}
    for x in got:
        assert crc(x.ids) == x.ids_crc32
        if x.doc_id not in (5, None):
            assert x.ids == texts[x.doc_id][x.start: x.start + x.length] and x.doc_tokens == len(texts[x.doc_id])
    for i, w in texts.items():
        if i not in (5, None):
            mine = sorted((x.start, x.length) for x in got if x.doc_id == i)
            assert [a for a, _ in mine] == [0, *np.cumsum([b for _, b in mine])[:-1]] and sum(b for _, b in mine) == len(w)


def test_pack_empty(spark):
    assert pack(frame(spark, [])).count() == 0


def test_level_choice_is_the_smallest_sum_of_squares():
    r = np.random.default_rng(0)
    p = SquaresPacker(32, 10_000)
    for _ in range(500):
        size = int(r.integers(1, 32))
        n = p.count.copy()
        squares = {}
        for h in [0, *[h for h in range(1, 32) if n[h] and h + size <= 32]]:
            m = n.copy()
            m[h] -= h > 0
            m[h + size] += h + size < 32
            squares[h] = int((m[1:32] ** 2).sum())
        assert squares[p.level_for(size)] == min(squares.values())
        p.add(0, bytes(4 * size))
