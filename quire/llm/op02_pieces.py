"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly, by backtracking.

The automaton gives the longest piece that starts at each position. A piece is taken when the pair
it makes with the piece before re-merges to just these two, a property that holds for all adjacent
pairs of exactly one segmentation: the one that merging gives. Where none fits, the position's bit
is set and the last piece is replaced by its longest proper prefix among the pieces. As a prefix of
a text has one valid segmentation, a failed position never has to be tried again, and the work is
linear in the text.

Texts are cut before a space mark that follows another character, and at characters that only
occur alone; no piece of the vocabulary reaches over such a place (checked when the model is
loaded), so no merge does. Encoded parts are kept in a bounded cache.

Null text counts as empty: no ids, decoded to the empty text. Repeated rows each get a row; rows
with a null doc_id are kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table, tidy

MARK = "▁"
#: Parts of texts whose ids are kept; the cache is emptied when it is full.
CACHE_PARTS = 300_000
#: Parts whose decoded text is kept, by their ids.
SPOKEN_PARTS = 60_000
#: Pairs of pieces whose compatibility is kept.
MAX_PAIRS = 200_000


class Pieces:
    """A merge-type SentencePiece model: ``encode``, ``decode``."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("only merge-type models that leave the text as it is are supported")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.dummy = norm.add_dummy_prefix
        self.score = {p.piece: p.score for p in proto.pieces if p.type == 1}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        self.text = {i: p.piece for i, p in enumerate(proto.pieces) if p.type == 1}
        self.silent = {i for i, p in enumerate(proto.pieces) if p.type == 3}
        self.byte_id = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.id_byte = {i: b for b, i in self.byte_id.items()}
        self.unk = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.unk_surface = proto.trainer_spec.unk_surface or spm.SentencePieceProcessor(model_file=model_file).decode([self.unk])
        self.widest = max(map(len, self.score))
        self.cut_at_mark = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.joining = frozenset(c for p in self.score if len(p) > 1 for c in p)
        self.auto = ahocorasick.Automaton()
        for p in self.score:
            if len(p) > 1:
                self.auto.add_word(p, len(p))
        self.auto.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str] = {}
        joined = re.escape("".join(sorted(self.joining - {MARK})))
        self.parts = re.compile(f"{MARK}+[{joined}]*|[{joined}]+|." if self.cut_at_mark else f"[{MARK}{joined}]+|.", re.DOTALL)
        self.cache = _Parts(self)
        self.digits = {p: str(i) for p, i in self.ids.items()}
        #: Text of each id that stands for itself wherever it is.
        self.plain = {str(i): p.replace(MARK, " ") for p, i in self.ids.items()}
        self.spoken = _Spoken(self)

    def merge(self, text: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether merging leaves just these two pieces; with ``a`` empty, whether it makes ``b``."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return got

    def prefix(self, piece: str) -> str:
        """The longest proper prefix that is a piece; one character at least."""
        got = self.shorter.get(piece)
        if got is None:
            n = len(piece) - 1
            while n > 1 and piece[:n] not in self.score:
                n -= 1
            got = self.shorter[piece] = piece[:n]
        return got

    def segment(self, text: str) -> list[str]:
        """The pieces that merging would give, found by backtracking."""
        n = len(text)
        if n <= 1:
            return [text] if n else []
        longest = [1] * n
        for end, size in self.auto.iter(text):
            if size > longest[end - size + 1]:
                longest[end - size + 1] = size
        failed = bytearray((n >> 3) + 1)
        out: list[str] = []
        pairs, fits = self.pairs, self.fits
        last, pos = "", 0
        piece = text[: longest[0]]
        while True:
            end = pos + len(piece)
            ok = not failed[end >> 3] >> (end & 7) & 1
            if ok:
                ok = pairs.get((last, piece))
                if ok is None:
                    ok = fits(last, piece)
            if ok:
                out.append(piece)
                if end == n:
                    return out
                last, pos = piece, end
                piece = text[pos : pos + longest[pos]]
                continue
            while len(piece) == 1:
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = out.pop()
                last = out[-1] if out else ""
                pos -= len(piece)
            piece = self.prefix(piece)

    def piece_ids(self, piece: str) -> list[int]:
        got = self.ids.get(piece)
        if got is not None:
            return [got]
        return [self.byte_id.get(b, self.unk) for b in piece.encode()] if self.byte_id else [self.unk]

    def cut(self, text: str) -> list[str]:
        """Parts that are encoded each on its own."""
        return self.parts.findall(text)

    def marked(self, text: str) -> str:
        return (MARK if self.dummy else "") + text.replace(" ", MARK) if text else ""

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.cut(self.marked(text or "")) for p in self.segment(part) for i in self.piece_ids(p)]

    def decode(self, ids: list[int], begin: bool | None = None) -> str:
        """Text of any list of ids; runs of bytes that are no UTF-8 give a replacement character each.

        ``begin``: whether a first mark goes, as the model has it; not so for ids that follow others.
        """
        out: list[str] = []
        raw = bytearray()

        def flush() -> None:
            i = 0
            while i < len(raw):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(raw[i : i + size]).decode())
                        i += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            raw.clear()

        begin = self.dummy if begin is None else begin
        for i in ids:
            if i in self.id_byte:
                raw.append(self.id_byte[i])
                begin = False
                continue
            flush()
            if i in self.silent:
                continue
            if i not in self.text:
                out.append(self.unk_surface)
            else:
                piece = self.text[i]
                out.append((piece[1:] if begin and piece.startswith(MARK) else piece).replace(MARK, " "))
            begin = False
        flush()
        return "".join(out)

    def part_ids(self, text: str) -> str:
        """Ids of a part that stands for itself, joined by commas."""
        found, known = [], self.digits
        for part in self.cut(text):
            for piece in self.segment(part):
                got = known.get(piece)
                if got is None:
                    got = ",".join(map(str, self.piece_ids(piece)))
                found.append(got)
        return ",".join(found)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and of the text that the ids decode to."""
        if not text:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        if self.dummy and self.cut_at_mark and MARK not in text and "  " not in text and text[0] != " " != text[-1]:
            parts = list(map(self.cache.__getitem__, text.split(" ")))
        else:
            parts = list(map(self.part_ids, self.cut(self.marked(text))))
        ids = ",".join(parts)
        try:
            decoded = "".join(map(self.spoken.__getitem__, parts))
            if self.dummy and self.text[int(ids.split(",", 1)[0])].startswith(MARK):
                decoded = decoded[1:]
        except KeyError:  # parts that begin with a byte or an unknown piece
            decoded = self.decode(list(map(int, ids.split(","))))
        return ids.count(",") + 1, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


class _Parts(dict):
    """Ids of words that follow one space mark: two generations of CACHE_PARTS // 2 at most."""

    def __init__(self, model: Pieces):
        self.model = model
        self.old: dict[str, str] = {}

    def __missing__(self, word: str) -> str:
        got = self.old.get(word)
        if got is None:
            got = self.model.part_ids(MARK + word)
        if len(word) <= 64:
            if len(self) >= CACHE_PARTS // 2:
                self.old = dict(self)
                self.clear()
            self[word] = got
        return got


class _Spoken(dict):
    """Text that the joined ids of a part decode to: two generations of SPOKEN_PARTS // 2 at most.

    A part that begins with a piece ends any run of bytes before it, so it decodes by itself; others raise KeyError.
    """

    def __init__(self, model: Pieces):
        self.model, self.plain = model, model.plain
        self.old: dict[str, str] = {}

    def __missing__(self, ids: str) -> str:
        got = self.old.get(ids)
        if got is None:
            every = ids.split(",")
            try:
                got = "".join(map(self.plain.__getitem__, every))
            except KeyError:
                numbers = list(map(int, every))
                if every[0] not in self.plain or not self.model.silent.isdisjoint(numbers):
                    raise
                got = self.model.decode(numbers, begin=False)
        if len(ids) <= 128:
            if len(self) >= SPOKEN_PARTS // 2:
                self.old = dict(self)
                self.clear()
            self[ids] = got
        return got


_loaded: dict[str, Pieces] = {}


def pieces(model_file: str) -> Pieces:
    """One model a process."""
    if model_file not in _loaded:
        _loaded[model_file] = Pieces(model_file)
    return _loaded[model_file]


def encode_documents(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``n_tokens`` long added (replaced where they exist)."""
    keep = [c for c in docs.columns if c not in ("ids", "n_tokens")]
    src = docs.select(*keep)
    schema = T.StructType([*src.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())])

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        model = pieces(model_file)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                ids = [model.encode(t) for t in c.column(c.schema.get_field_index(text)).to_pylist()]
                arrays = [*c.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*c.schema.names, "ids", "n_tokens"])

    return src.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; null ids count as none."""
    src = df.select(*[c for c in df.columns if c != out])
    schema = T.StructType([*src.schema.fields, T.StructField(out, T.StringType())])

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        model = pieces(model_file)
        for b in batches:
            got = [model.decode(x or []) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, out])

    return src.mapInArrow(run, schema)


DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """Digests of the ids and of the decoded text of each row of ``docs``; one pass, no shuffle."""

    @tidy
    def run(batches: Iterator):
        import pyarrow as pa

        model = pieces(model_file)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                got = [model.digest(t) for t in c.column(1).to_pylist()]
                cols = list(zip(*got)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [c.column(0).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, DIGEST)


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())
