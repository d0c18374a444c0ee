"""Encoders of texts and images as vectors.

An encoder is any picklable object with ``dim`` and ``encode(values) -> (n, dim)``; it is broadcast, and its ``load`` is called
at the beginning of each task, to get ready whatever it hasn't yet. :class:`HashingEncoder` needs nothing but NumPy. Models of the
usual deep learning libraries are wrapped by :func:`deep_text` and :func:`deep_image` where those are installed; :data:`ZOO` lists
well-known checkpoints.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Encoder(Protocol):
    dim: int

    def load(self) -> None: ...

    def encode(self, values: list) -> np.ndarray: ...


@dataclass
class HashingEncoder:
    """Signed feature hashing of words and their neighbours, in unit length; an empty text is the zero vector."""

    dim: int = 64
    grams: int = 2

    def load(self) -> None:
        pass

    def encode(self, values: list) -> np.ndarray:
        out = np.zeros((len(values), self.dim))
        for k, text in enumerate(values):
            words = (text or "").lower().split()
            for n in range(1, self.grams + 1):
                for i in range(len(words) - n + 1):
                    h = zlib.crc32(" ".join(words[i : i + n]).encode())
                    out[k, h % self.dim] += 1.0 if h >> 31 else -1.0
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, norm, out=out, where=norm > 0)


@dataclass
class BytesEncoder:
    """Histogram of byte values in ``dim`` bins: a stand-in for image models where none is installed."""

    dim: int = 32

    def load(self) -> None:
        pass

    def encode(self, values: list) -> np.ndarray:
        counts = [np.bincount(np.frombuffer(v or b"", np.uint8).astype(int) * self.dim // 256, minlength=self.dim) / max(1, len(v or b"")) for v in values]
        return np.array(counts, float).reshape(len(values), self.dim)


@dataclass
class FileEncoder:
    """Reads the files that the values name, local or on any file system Arrow knows, and encodes their bytes."""

    inner: Encoder
    root: str = ""

    @property
    def dim(self) -> int:
        return self.inner.dim

    def load(self) -> None:
        self.inner.load()

    def encode(self, values: list) -> np.ndarray:
        from pyarrow import fs

        out = []
        for v in values:
            path = f"{self.root.rstrip('/')}/{v}" if self.root else v
            where, p = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            with where.open_input_stream(p) as f:
                out.append(f.read())
        return self.inner.encode(out)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel(), pa.float32()))


def encode_column(encoder: Encoder, column: str | Column, batch_size: int = 32) -> Column:
    """The column's ``array<float>`` embedding, in mini-batches: no more values than those are Python objects at a time. The encoder is broadcast, so that a worker has one for all its tasks."""
    sent = SparkSession.active().sparkContext.broadcast(encoder)

    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        own.load()
        for b in batches:
            parts = [_lists(np.asarray(own.encode(b.slice(s, batch_size).to_pylist()), np.float32)) for s in range(0, len(b), batch_size)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float32()))

    return run(column).cast("array<double>")


@dataclass(frozen=True)
class Checkpoint:
    """A public model: its name in the usual hub, what it takes, its usual width, and the libraries that have its weights.

    The width only says what to expect: a prepared modality's is taken from its vectors.
    """

    name: str
    kind: str
    dim: int
    libraries: tuple[str, ...]


_BOTH, _TORCH, _TF = ("torch", "tensorflow"), ("torch",), ("tensorflow",)
_TEXTS = {
    (_BOTH, 256): "google/electra-small-discriminator google/electra-small-generator",
    (_BOTH, 320): "facebook/esm2_t6_8M_UR50D",
    (_BOTH, 512): "lordtt13/emo-mobilebert facebook/blenderbot_small-90M",
    (_BOTH, 768): "roberta-base openai-gpt microsoft/mpnet-base microsoft/deberta-base distilgpt2 distilbert-base-uncased cardiffnlp/twitter-roberta-base-emotion bert-base-cased allenai/led-base-16384 albert-base-v2 xlnet-base-cased",
    (_BOTH, 1024): "facebook/xglm-564M facebook/mbart-large-cc25 andreasmadsen/efficient_mlm_m0.40",
    (_BOTH, 1152): "google/rembert",
    (_BOTH, 1280): "ctrl",
    (_BOTH, 1472): "google/byt5-small",
    (_BOTH, 1536): "microsoft/deberta-v2-xlarge",
    (_BOTH, 2048): "xlm-mlm-en-2048",
    (_TORCH, 512): "ArthurZ/opt-350m-dummy-sc",
    (_TORCH, 768): "uw-madison/yoso-4096 uw-madison/nystromformer-512 squeezebert/squeezebert-uncased nghuyong/ernie-2.0-base-en l-yohai/bigbird-roberta-base-mnli kssteven/ibert-roberta-base jpwahle/longformer-base-plagiarism-detection google/switch-base-8 google/canine-s google/canine-c facebook/xmod-base facebook/xlm-v-base ArthurZ/dummy-rocbert-seq",
    (_TORCH, 1024): "valhalla/bart-large-sst2 sberbank-ai/sbert_large_nlu_ru microsoft/DialogRPT-updown bigscience/bloom-560m RUCAIBox/mvp",
    (_TORCH, 2048): "EleutherAI/gpt-neo-1.3B",
    (_TF, 512): "t5-small google/flan-t5-small",
    (_TF, 768): "google/t5-v1_1-base",
    (_TF, 1024): "transfo-xl-wt103",
    # beyond those: other sizes, languages and sentence models
    (_TORCH, 384): "sentence-transformers/all-MiniLM-L6-v2",
    (_BOTH, 768, "more"): "xlm-roberta-base sentence-transformers/all-mpnet-base-v2 gpt2 google/electra-base-discriminator distilbert-base-multilingual-cased bert-base-uncased bert-base-multilingual-cased",
    (_BOTH, 1024, "more"): "roberta-large bert-large-uncased albert-large-v2",
}
_IMAGES = {
    (_BOTH, 640): "apple/mobilevit-small",
    (_BOTH, 768): "microsoft/swin-tiny-patch4-window7-224 google/vit-base-patch16-224-in21k facebook/deit-base-distilled-patch16-224 facebook/convnext-tiny-224",
    (_BOTH, 1088): "facebook/regnet-y-040",
    (_TORCH, 384): "facebook/levit-128S",
    (_TORCH, 512): "Visual-Attention-Network/van-base",
    (_TORCH, 768): "microsoft/swinv2-tiny-patch4-window8-256 microsoft/beit-base-patch16-224-pt22k facebook/convnextv2-tiny-1k-224",
    (_TORCH, 1024): "google/mobilenet_v1_1.0_224",
    (_TORCH, 1280): "google/mobilenet_v2_1.0_224",
    (_TORCH, 2048): "google/bit-50",
    (_TORCH, 2560): "google/efficientnet-b7",
    (_BOTH, 768, "more"): "google/vit-base-patch16-224 facebook/deit-base-patch16-224",
    (_BOTH, 1024, "more"): "microsoft/swin-base-patch4-window7-224 google/vit-large-patch16-224 facebook/convnext-base-224",
    (_BOTH, 2048, "more"): "microsoft/resnet-50",
}
ZOO = {n: Checkpoint(n, kind, key[1], key[0]) for kind, table in (("text", _TEXTS), ("image", _IMAGES)) for key, names in table.items() for n in names.split()}


@dataclass
class TransformerText:
    """Mean of a text model's last layer over all tokens of a text; needs the models' library and ``torch`` or ``tensorflow`` on the executors.

    A text longer than the model takes is cut into windows that it takes, whose tokens all count alike: none is dropped.
    """

    checkpoint: str
    dim: int
    library: str = "torch"
    #: Windows in one call of the model, and tokens of one where the model has no bound of its own.
    at_once: int = 32
    longest: int = 4096

    def load(self) -> None:
        if not hasattr(self, "_model"):
            import transformers

            self._tokens = transformers.AutoTokenizer.from_pretrained(self.checkpoint)
            if self._tokens.pad_token is None:
                self._tokens.pad_token = self._tokens.eos_token
            auto = transformers.AutoModel if self.library == "torch" else transformers.TFAutoModel
            self._model = auto.from_pretrained(self.checkpoint)
            _freeze(self._model, self.library)

    def encode(self, values: list) -> np.ndarray:
        t, windows, of = self._tokens, [], []
        room = max(1, min(t.model_max_length, self.longest) - t.num_special_tokens_to_add())
        for k, v in enumerate(values):
            ids = t.encode(v or "", add_special_tokens=False)
            for s in range(0, max(1, len(ids)), room):
                windows.append(t.build_inputs_with_special_tokens(ids[s : s + room]))
                of.append(k)
        total, n = np.zeros((len(values), self.dim)), np.zeros(len(values))
        for s in range(0, len(windows), self.at_once):
            x = t.pad({"input_ids": windows[s : s + self.at_once]}, return_tensors="pt" if self.library == "torch" else "tf")
            h = np.asarray(_calm(self._model, self.library, x).last_hidden_state)
            m = np.asarray(x["attention_mask"])[:, :, None]
            if total.shape[1] != h.shape[2]:
                total = np.zeros((len(values), h.shape[2]))
            np.add.at(total, of[s : s + self.at_once], (h * m).sum(1))
            np.add.at(n, of[s : s + self.at_once], m.sum((1, 2)))
        return total / np.maximum(n, 1)[:, None]


@dataclass
class TransformerImage:
    """A vision model's pooled output (or the mean of its last layer) of pictures given as bytes; null or empty bytes are the zero vector."""

    checkpoint: str
    dim: int
    library: str = "torch"

    def load(self) -> None:
        if not hasattr(self, "_model"):
            import transformers

            self._processor = transformers.AutoImageProcessor.from_pretrained(self.checkpoint)
            auto = transformers.AutoModel if self.library == "torch" else transformers.TFAutoModel
            self._model = auto.from_pretrained(self.checkpoint)
            _freeze(self._model, self.library)

    def encode(self, values: list) -> np.ndarray:
        import io

        from PIL import Image

        some = [k for k, v in enumerate(values) if v]
        if not some:
            return np.zeros((len(values), self.dim))
        x = self._processor(images=[Image.open(io.BytesIO(values[k])).convert("RGB") for k in some], return_tensors="pt" if self.library == "torch" else "tf")
        got = _calm(self._model, self.library, x)
        pooled = getattr(got, "pooler_output", None)
        v = np.asarray(pooled if pooled is not None else got.last_hidden_state)
        if pooled is None:
            v = v.reshape(len(some), -1, v.shape[-1]).mean(1)
        out = np.zeros((len(values), v.reshape(len(some), -1).shape[1]))
        out[some] = v.reshape(len(some), -1)
        return out


def _freeze(model, library: str) -> None:
    if library == "torch":
        model.eval()


def _calm(model, library: str, inputs):
    """The model's output, without gradients."""
    if library != "torch":
        return model(**inputs)
    import torch

    with torch.no_grad():
        return model(**inputs)


def _from_zoo(name: str, kind: str, library: str) -> Checkpoint:
    c = ZOO.get(name)
    if c is None or c.kind != kind or library not in c.libraries:
        raise ValueError(f"no {kind} model {name!r} for {library}")
    return c


def deep_text(name: str, library: str = "torch") -> TransformerText:
    return TransformerText(name, _from_zoo(name, "text", library).dim, library)


def deep_image(name: str, library: str = "torch") -> TransformerImage:
    return TransformerImage(name, _from_zoo(name, "image", library).dim, library)
