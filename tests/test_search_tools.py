"""Reports, the surrogate optimiser, adapters against stand-ins of the libraries, clean-up, data sets."""

import io
import logging
import math
import sys
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaica.functions.encoders import ZOO, deep_image, deep_text
from mosaica.modality import ID, Modality, MultiFrame
from mosaica.plans import report
from mosaica.plans.search import AlgoConf, RandomOpt, optuna_opt
from mosaica.plans.surrogate import Forest, ForestOpt, expected_improvement
from mosaica.sources import files
from mosaica.sources.datasets import register_tables


class Bowl:
    """An 'algorithm' whose value is known: least at x = 0.3, n = 7, kind = b; it can't be made where x is over 0.95."""

    def __init__(self, x, n, kind, fixed):
        if x > 0.95:
            raise ValueError("x")
        self.value = (x - 0.3) ** 2 + 0.01 * (n - 7) ** 2 + (0 if kind == "b" else 0.5)

    def fit_predict_with_model(self, frame):
        return self, self.value


class Given:
    name = "GIVEN"

    @staticmethod
    def evaluate(labelled, minimise):
        return labelled


@pytest.fixture(scope="module")
def conf():
    return AlgoConf(Bowl, {"x": (0.0, 1.0), "n": (1, 20), "kind": {"a", "b", "c"}, "fixed": 4})


@pytest.fixture(scope="module")
def frame(spark):
    return MultiFrame(spark.range(1).select(F.col("id").alias(ID)), (Modality("v", 2),), 1000)


def test_surrogate(conf, frame):
    best = {c: [] for c in (ForestOpt, RandomOpt)}
    for c in best:
        for seed in range(6):
            o = c(conf, frame, Given, seed)
            for _ in range(50):
                o.step()
            assert o.optimal.value == min(h.value for h in o.history) and len(o.history) == 50
            assert all(0 <= h.params["x"] <= 1 and h.params["n"] in range(1, 21) and h.params["fixed"] == 4 for h in o.history)
            best[c].append(o.optimal.value)
    assert np.mean(best[ForestOpt]) < np.mean(best[RandomOpt]) and np.median(best[ForestOpt]) < 0.02
    a, b = (ForestOpt(conf, frame, Given, 3) for _ in range(2))
    assert [a.step().params for _ in range(12)] == [b.step().params for _ in range(12)]


def test_surrogate_that_always_fails(frame):
    o = ForestOpt(AlgoConf(Bowl, {"x": (0.96, 1.0), "n": 1, "kind": "a", "fixed": 1}), frame, Given)
    assert all(math.isinf(o.step().value) for _ in range(8)) and o.optimal is None
    o = ForestOpt(AlgoConf(Bowl, {"x": 0.5, "n": 1, "kind": "a", "fixed": 1}), frame, Given)
    assert len({o.step().value for _ in range(8)}) == 1


def test_forest():
    r = np.random.default_rng(1)
    x = r.random((300, 3))
    mean, std = Forest(x, np.where(x[:, 1] > 0.5, 3.0, 1.0), r).predict(np.array([[0.5, 0.9, 0.5], [0.5, 0.1, 0.5]]))
    assert mean == pytest.approx([3, 1], abs=0.1) and (std >= 0).all()
    assert expected_improvement(np.array([0.0, 2.0, 1.0]), np.array([0.0, 0.0, 1.0]), 1.0) == pytest.approx([1.0, 0.0, 1 / math.sqrt(2 * math.pi)])


def test_optuna_adapter(conf, frame, monkeypatch):
    """Against a stand-in with the calls that the adapter makes."""
    told = []

    class Trial:
        suggest_int = staticmethod(lambda name, lo, hi: lo)
        suggest_float = staticmethod(lambda name, lo, hi: (lo + hi) / 2 if len(told) < 2 else hi)
        suggest_categorical = staticmethod(lambda name, values: values[-1])

    study = types.SimpleNamespace(ask=Trial, tell=lambda trial, value: told.append(value))
    monkeypatch.setitem(sys.modules, "optuna", types.SimpleNamespace(create_study=lambda sampler: study, samplers=types.SimpleNamespace(TPESampler=lambda seed: seed)))
    o = optuna_opt(conf, frame, Given, 1)
    runs = [o.step() for _ in range(3)]
    assert runs[0].params == {"x": 0.5, "n": 1, "kind": "c", "fixed": 4}
    assert told == [runs[0].value, runs[1].value, float(0xBADBADBADBAD)] and math.isinf(runs[2].value)


def test_reports(conf, frame):
    out = io.StringIO()
    before = list(report.log.handlers)
    try:
        for level, want in ((report.Level.NONE, set()), (report.Level.BRIEF, {"Bowl took", "evaluation by GIVEN took"}), (report.Level.INFO, {"Bowl began", "params:", "result:"})):
            out.truncate(0)
            report.tell(level, out)
            RandomOpt(conf, frame, Given, 2).step()
            assert all(w in out.getvalue() for w in want) and bool(want) == bool(out.getvalue())
            report.log.handlers[:] = before
        report.tell(report.Level.FULL, out)
        out.truncate(0)
        with report.timed("it", x=1) as found:
            found["inner"] = 5
        with pytest.raises(KeyError), report.timed("that"):
            raise KeyError("k")
        assert "it began, x: 1" in out.getvalue() and "inner: 5" in out.getvalue() and "that failed" in out.getvalue()
    finally:
        report.log.handlers[:] = before
        report.tell(report.Level.NONE)
        logging.getLogger("mosaica").setLevel(logging.NOTSET)
    assert report.clock(3723.0456) == "01:02:03.045"




def _library(longest=6):
    """A stand-in for the models' library: a token for each character, and its code as a vector of width 2."""

    class Tokens:
        pad_token, eos_token, model_max_length = None, "<e>", longest
        from_pretrained = classmethod(lambda cls, name: cls())
        num_special_tokens_to_add = staticmethod(lambda: 2)
        encode = staticmethod(lambda text, add_special_tokens: [ord(c) for c in text])
        build_inputs_with_special_tokens = staticmethod(lambda ids: [1, *ids, 2])

        @staticmethod
        def pad(x, return_tensors):
            rows = x["input_ids"]
            n = max(map(len, rows))
            return {"input_ids": np.array([r + [0] * (n - len(r)) for r in rows]), "attention_mask": np.array([[1] * len(r) + [0] * (n - len(r)) for r in rows])}

    class Model:
        loads = 0

        @classmethod
        def from_pretrained(cls, name):
            cls.loads += 1
            return cls()

        def eval(self):
            pass

        def __call__(self, input_ids=None, attention_mask=None, pixels=None):
            if pixels is not None:
                return types.SimpleNamespace(pooler_output=np.array(pixels))
            assert input_ids.shape[1] <= longest
            return types.SimpleNamespace(last_hidden_state=np.stack([input_ids, np.ones_like(input_ids)], axis=2).astype(float))

    class Processor:
        from_pretrained = classmethod(lambda cls, name: cls())
        __call__ = lambda self, images, return_tensors: {"pixels": [[len(i), 1.0] for i in images]}

    class Calm:
        __enter__ = __exit__ = lambda self, *a: None

    picture = types.SimpleNamespace(open=lambda f: types.SimpleNamespace(convert=lambda mode, f=f: f.read()))
    return {"transformers": types.SimpleNamespace(AutoTokenizer=Tokens, AutoModel=Model, TFAutoModel=Model, AutoImageProcessor=Processor), "torch": types.SimpleNamespace(no_grad=Calm), "PIL": types.SimpleNamespace(Image=picture), "PIL.Image": picture}, Model


@pytest.mark.parametrize("library", ["torch", "tensorflow"])
def test_wrappers(monkeypatch, library):
    modules, model = _library()
    for name, m in modules.items():
        monkeypatch.setitem(sys.modules, name, m)
    e = deep_text("bert-base-cased", library)
    e.load(), e.load()
    assert model.loads == 1
    texts = ["abc", "a text of more than a window", "", None]
    got = e.encode(texts)
    for t, v in zip(texts, got):
        cut = [(t or "")[s : s + 4] for s in range(0, max(1, len(t or "")), 4)]
        tokens = [x for c in cut for x in (1, *map(ord, c), 2)]
        assert v.tolist() == pytest.approx([np.mean(tokens), 1])
    p = deep_image("apple/mobilevit-small", library)
    p.load()
    assert p.encode([b"12345", None, b"1"]).tolist() == [[5, 1], [0, 0], [1, 1]]
    assert p.encode([None]).shape == (1, 640)


def test_zoo():
    n = lambda kind, library: sum(c.kind == kind and library in c.libraries for c in ZOO.values())
    assert n("text", "torch") >= 44 and n("text", "tensorflow") >= 28 and n("image", "torch") >= 15 and n("image", "tensorflow") >= 6
    for wrong in (("bert-base-cased", "image"), ("t5-small", "torch"), ("nope", "torch")):
        with pytest.raises(ValueError):
            (deep_image if wrong[1] == "image" else deep_text)(wrong[0], "torch")


def test_clean(spark):
    df = spark.createDataFrame([(" a.b ", "7 ", "x"), ("c", "?", "xy"), (None, None, "z")], "p string, n string, q string")
    got = files.clean(df, trims=["p"], ints=["n"], splits={"second": ("p", ".", 1)}, joins={"both": ["p", F.lit("+"), "q"]}, holding={"q": "x"}, renames={"n": "number"}).collect()
    assert [tuple(r) for r in got] == [("a.b", 7, "x", "b", "a.b+x"), ("c", None, "xy", None, "c+xy")]


def test_data_sets(spark, tmp_path):
    names = register_tables("/root/testdata/sf0.001")
    assert set(names) == {"customers", "parts", "lines", "embeddings", "documents", "blobs"}
    f = files.by_name("parts").preprocessed(spark, str(tmp_path / "cache"))
    assert f.amount == 200 and {m.name for m in f.modalities} == {"kind", "price", "p_name"}
    again = files.by_name("parts").preprocessed(spark, str(tmp_path / "cache"))
    assert again.modalities == f.modalities and again.df.count() == 200
    b = files.by_name("blobs")
    assert b.raw(spark).count() == 10_000 and b.preprocessed(spark).global_dim == 50
