import random

import numpy as np
import sentencepiece

from keysweep.llm import pieces as P
from keysweep.llm.common import read

from conftest import SF_SMALL
from edge import ROWS, frame


def ids(x):
    return np.frombuffer(x, "<u4").tolist()


def test_same_ids_as_the_model_itself_and_exact_round_trip(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=P.default_path())
    docs = read(spark, SF_SMALL, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    encoded = P.encode(docs)
    for r in encoded.collect():
        assert ids(r["ids"]) == model.encode(texts[r["doc_id"]]) and r["n_ids"] == len(ids(r["ids"]))
    for r in P.decode(encoded).collect():
        assert r["text"] == texts[r["doc_id"]]


def test_odd_texts():
    model, pieces, r = sentencepiece.SentencePieceProcessor(model_file=P.default_path()), P.Pieces(P.default_path()), random.Random(4)
    texts = ["".join(r.choice(" \n\tabthe▁é日🙂.\x07") for _ in range(r.randint(0, 60))) for _ in range(1500)]
    assert [ids(x) for x in pieces.encode_batch(texts)] == [model.encode(t) for t in texts]
    assert pieces.encode_batch(texts) == [pieces.encode_batch([t])[0] for t in texts]  # what it remembers changes nothing


def test_edge_rows(spark):
    got = P.encode(frame(spark))
    assert sorted((r["doc_id"] or 0) for r in got.collect()) == sorted((i or 0) for i, _ in ROWS)
    back = sorted((r["doc_id"] or 0, r["text"]) for r in P.decode(got).collect())
    assert back == sorted((i or 0, t or "") for i, t in ROWS)
    assert P.encode(frame(spark, [])).collect() == []
