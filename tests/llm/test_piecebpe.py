import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from public_tokenizers import path

from bidlens.llm import piecebpe, queries
from util import awkward, docs

MODEL = path("piece_bpe_32k.model")
V = piecebpe.read_model(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(seed, n):
    rng = random.Random(seed)
    chars = list("abcdefghijklmnopqrstuvwxyzABCDE   \n.,'-_=/0123456789éüßñ日本語のあ😀▁̀²\t\0")
    pieces = list(V.ids)
    out = ["", " ", "  ", " a", "▁x", "\0x", "   \n  \t x", "a" * 300, " " * 37, "\r\n\r\n", "x ", "²."]
    for _ in range(n):
        out.append("".join(rng.choice(chars) for _ in range(rng.randint(1, 40))))
        out.append("".join(rng.choice(pieces).replace("▁", rng.choice("▁ ")) for _ in range(rng.randint(1, 8))))
        out.append("".join(rng.choice("ab ") for _ in range(rng.randint(1, 100))))
        out.append("".join(rng.choice("eins th") for _ in range(rng.randint(1, 200))))
    return out


def test_same_ids_and_text_as_the_library():
    cases = texts(12, 1500)
    one, many = piecebpe.Encoder(V), piecebpe.Encoder(V).encode_all(cases, group=2000)
    for t, ids in zip(cases, many):
        want = LIBRARY.encode(t)
        assert one.encode(t).tolist() == want, t
        assert ids.tolist() == want, t
        assert piecebpe.decode_ids(want, V) == LIBRARY.decode(want)


def test_pairs_fit_as_re_merging_says():
    e, rng = piecebpe.Encoder(V), random.Random(13)
    ids = list(V.whole.values())
    for _ in range(20000):
        a, b = rng.choice(ids), rng.choice(ids)
        left, right = V.pieces[a], V.pieces[b]
        assert e.joins(a, b) == (piecebpe.merge(left + right, V.scores) == [left, right])


def test_decode_of_any_ids():
    rng = random.Random(14)
    for _ in range(5000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 28705, 1, 0]) for _ in range(rng.randint(0, 9))]
        assert piecebpe.decode_ids(ids, V) == LIBRARY.decode(ids)


def test_long_text_and_blocks():
    rng = random.Random(15)
    long = "".join(rng.choice("etaoin  shrdlu\n") for _ in range(50_000)) + "x" * 5000
    e = piecebpe.Encoder(V)
    assert e.encode(long, block=1000).tolist() == e.encode(long).tolist() == LIBRARY.encode(long)


def test_other_models_are_refused(tmp_dir):
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.normalizer_spec.remove_extra_whitespaces = True
    with open(f"{tmp_dir}/m.model", "wb") as f:
        f.write(m.SerializeToString())
    with pytest.raises(ValueError):
        piecebpe.read_model(f"{tmp_dir}/m.model")


def test_rows(spark):
    rows = awkward(12) + [(900 + i, t, None, None) for i, t in enumerate(texts(16, 100))]
    df = piecebpe.decode(piecebpe.encode(docs(spark, rows), MODEL, out_col="ids"), MODEL, ids_col="ids")
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in df.collect())
    want = Counter((i, tuple(LIBRARY.encode(t or "")), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t, *_ in rows)
    assert got == want
    assert df.where("size != 'x'").count() == 0
    both = piecebpe.encode(docs(spark, rows), MODEL, decoded_col="back").collect()
    assert Counter((r.doc_id, tuple(r.ids), r.back) for r in both) == want
    assert piecebpe.encode(docs(spark, []), MODEL).count() == 0
    none = spark.createDataFrame([(None,)], "ids array<int>")
    assert piecebpe.decode(none, MODEL).first().decoded is None


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = LIBRARY.encode(r.text or "")
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids)))
    got = queries.QUERIES["op12_piece_bpe"](spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want
