"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of all new words of a batch lie in one flat numpy array. A round looks up the rank of every adjacent pair,
takes the smallest rank of each word (a segmented minimum), merges its leftmost non-overlapping occurrences in all words
at once and compacts the arrays; the rounds end when no word has a pair left.

A word here is a run of meta spaces with the characters after it, cut further where no piece of the model spans. No
piece may hold a character other than the meta space before a meta space (checked when the model is read), so merges
never cross words and each distinct word is encoded once per task and remembered in a bounded table.

Defined results: null text encodes as the empty text, to no ids; null ids decode to the empty text; repeated rows and
ties are encoded alike; other columns pass through unchanged.
"""

from __future__ import annotations

import codecs
import re
import string
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.batches import list_array, sliced, text_column

#: Distinct words a task remembers before it forgets them all.
REMEMBERED = 120_000
#: Bytes of text encoded at a time.
SLICE = 1 << 19
SPACE = "▁"
_NONE = np.iinfo(np.int32).max

codecs.register_error("piece_bytes", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """Tables of one model: piece bytes, and for each pair of piece ids the rank and id of their merge."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(names) if plain[i]}
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece holds a meta space after another character; words are not independent")
        self.char = {p: i for p, i in ids.items() if len(p) == 1}
        # Characters that stand next to each other in some piece; merges never cross others.
        self.beside = np.array(sorted({ord(a) << 32 | ord(b) for p in ids for a, b in pairwise(p)}), dtype=np.int64)
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        self.unknown = sp.unk_id()
        order = sorted(ids.values(), key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        pairs = sorted(
            (ids[p[:k]] << 32 | ids[p[k:]], rank[i], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids
        )
        self.pairs = np.array([p[0] for p in pairs], dtype=np.int64)
        self.rank = np.array([p[1] for p in pairs], dtype=np.int32)
        self.by_rank = np.array(order, dtype=np.int32)
        self._index()
        shown = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.lengths = np.array([len(b) for b in shown], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(shown), dtype=np.uint8)
        joints = re.escape("".join(c for c in "\n\t" if c not in self.char and not any(c in p for p in ids)))
        # A word is also cut after Latin letters where a character follows that no piece holds behind such a letter.
        latin = "A-Za-zÀ-ÖØ-öø-ɏ"
        behind = {c for p in ids for c in re.findall(f"(?<=[{latin}])[^{latin}]", p)}
        enders = re.escape("".join(c for c in string.punctuation if c not in behind))
        self.splitter = re.compile(f"{SPACE}*[{latin}]+(?=[{SPACE}{enders}{joints}]|\\Z)|{SPACE}*[^{SPACE}{joints}]+|{SPACE}+" + (f"|[{joints}]" if joints else ""))
        self._held_against(sp)

    def _held_against(self, sp) -> None:
        """A model that normalises, adds or folds spaces otherwise, or is no BPE model, is refused."""
        for probe in ("ﬁ ① Å é", "  two  spaces ", "x", "\tTabs\n and\u3000wide", "The quick brown fox"):
            found = self.splitter.findall(SPACE + probe.replace(" ", SPACE))
            if self.encode_words(found)[0].tolist() != sp.encode(probe):
                raise ValueError(f"the model does not encode {probe!r} as plain byte-pair merges with a space in front")

    def _index(self) -> None:
        """Direct tables of places in ``pairs``; each holds the pairs whose slots in the tables before it are taken."""
        self.slots = []
        left = np.arange(len(self.pairs), dtype=np.int32)
        while len(left):
            bits, factor = max(8, int(len(left)).bit_length() + 4), 0x9E3779B97F4A7C15 + 2 * len(self.slots) * 0x632BE59BD9B4E019 & (1 << 64) - 1
            slot, first = np.unique(self._slot(self.pairs[left], bits, factor), return_index=True)
            table = np.zeros(1 << bits, dtype=np.int32)
            table[slot] = left[first]
            self.slots.append((bits, factor, table))
            left = np.delete(left, first)

    @staticmethod
    def _slot(key: np.ndarray, bits: int, factor: int) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)).view(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a number above all ranks if it doesn't merge."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(len(key), _NONE, dtype=np.int32)
        for bits, factor, table in self.slots:
            at = table[self._slot(key, bits, factor)]
            out = np.where(self.pairs[at] == key, self.rank[at], out)
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words and the number of ids of each."""
        counts = np.array([len(w) for w in words], dtype=np.int64)
        of_word = np.repeat(np.arange(len(words), dtype=np.int32), counts)
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        distinct, inverse = np.unique(points, return_inverse=True)
        # A character without a piece is the symbol -1 - code point; it takes no part in merges.
        symbols = np.array([self.char.get(chr(p), -1 - p) for p in distinct.tolist()], dtype=np.int32)[inverse]
        pair = points[:-1] << 32 | points[1:]
        apart = self.beside[np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)] != pair
        # From here on a word is a part of one that merges can't leave.
        word = np.concatenate([[0], np.cumsum(apart | (of_word[1:] != of_word[:-1]))]).astype(np.int32)
        order = np.arange(len(symbols), dtype=np.int64)
        rank = np.full(len(symbols), _NONE, dtype=np.int32)  # of the pair of a symbol and the next one
        rank[:-1] = np.where(word[:-1] == word[1:], self._ranks(symbols[:-1], symbols[1:]), _NONE)
        done = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(symbols))))
            over = least == _NONE
            if over.any():  # words without a pair are done and leave the arrays
                done.append((symbols[over], word[over], order[over]))
                symbols, word, order, rank, least = (x[~over] for x in (symbols, word, order, rank, least))
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == least)
            # Of a run of overlapping occurrences every second one merges, from the left.
            place = np.arange(len(hit))
            place -= np.maximum.accumulate(np.where(np.concatenate([[True], np.diff(hit) > 1]), place, 0))
            hit = hit[place % 2 == 0]
            state = self._merged(symbols, word, order, rank, hit)
            if (early := self._early(word, rank, hit, state)).any():
                leftmost = np.concatenate([[True], word[hit][1:] != word[hit][:-1]])
                state = self._merged(symbols, word, order, rank, hit[leftmost | ~early])
            symbols, word, order, rank = state[:4]
        symbols, order = (np.concatenate(x) for x in zip(*((s, o) for s, _, o in done), strict=True))
        put = np.argsort(order, kind="stable")
        return self._with_bytes(symbols[put].astype(np.int64), of_word[order[put]], len(words))

    def _merged(self, symbols, word, order, rank, hit):
        keep = np.ones(len(symbols), dtype=bool)
        keep[hit + 1] = False
        new = symbols.copy()
        new[hit] = self.by_rank[rank[hit]]
        at = hit - np.arange(len(hit))  # of the merged symbols once the arrays are compact
        new, word, order, rank = new[keep], word[keep], order[keep], rank[keep]
        touched = np.concatenate([at, at[at > 0] - 1])
        rank[touched] = _NONE
        touched = touched[touched + 1 < len(new)]
        touched = touched[word[touched] == word[touched + 1]]
        rank[touched] = self._ranks(new[touched], new[touched + 1])
        return new, word, order, rank, at

    @staticmethod
    def _early(word, rank, hit, state):
        """Merges of words with several at once where one made a pair of a still smaller rank: that pair comes first."""
        _, _, _, now, at = state
        several = np.zeros(len(hit), dtype=bool)
        same = word[hit][1:] == word[hit][:-1]
        several[1:] |= same
        several[:-1] |= same
        smaller = np.minimum(now[at], np.where(at > 0, now[at - 1], _NONE)) < rank[hit]
        bad = np.unique(word[hit][several & smaller])
        return several & np.isin(word[hit], bad)

    def _with_bytes(self, symbols, word, n):
        """Replace characters without a piece by their byte pieces."""
        lost = np.flatnonzero(symbols < 0)
        if len(lost):
            raw = [chr(-1 - s).encode() for s in symbols[lost].tolist()]
            counts = np.ones(len(symbols), dtype=np.int64)
            counts[lost] = [len(b) for b in raw]
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            out = np.repeat(symbols, counts)
            flat = self.byte[np.frombuffer(b"".join(raw), dtype=np.uint8)]
            lens = counts[lost]
            out[np.repeat(starts[lost] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())] = flat
            symbols, word = out, np.repeat(word, counts)
        return symbols, np.bincount(word, minlength=n)

    def decode_ids(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; the space that encoding puts before a text is removed again."""
        ids = ids.astype(np.int64)
        lens = self.lengths[ids]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.bytes[np.repeat(self.offsets[ids] - (ends - lens), lens) + np.arange(total)].tobytes() if total else b""
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        out = []
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
            if flat[a : a + 1] == b" ":
                a += 1
            out.append(flat[a:b].decode("utf-8", "piece_bytes"))
        return out


_MODELS: dict[str, PieceModel] = {}
_TABLES: dict[str, _WordTable] = {}


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _table(path: str) -> _WordTable:
    if path not in _TABLES:
        _TABLES[path] = _WordTable(_model(path))
    return _TABLES[path]


class _WordTable:
    """Ids of the words met so far, flat, with the place of each word."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.counts = np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = self.model.splitter.findall
        words, sizes = [], []
        for t in texts:
            found = split(SPACE + t.replace(" ", SPACE)) if t else []
            words += found
            sizes.append(len(found))
        if len(self.place) > REMEMBERED:
            self.clear()
        place = self.place
        new = list(dict.fromkeys(w for w in words if w not in place))
        if new:
            ids, counts = self.model.encode_words(new)
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
            self.counts = np.concatenate([self.counts, counts])
            self.flat = np.concatenate([self.flat, ids])
        at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
        counts = self.counts[at]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(total)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return ids, np.diff(upto)


def _mapped(df: DataFrame, model_path: str, text: str | None, ids: str, decoded: str | None) -> DataFrame:
    """One pass that encodes (with ``text``) and decodes (with ``decoded``), so that a task has one Python worker."""
    base = df.drop(*([ids] if text else []), *([decoded] if decoded else []))
    added = ([f"`{ids}` array<int>"] if text else []) + ([f"`{decoded}` string"] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model_path)
        for part in sliced(batches, text, SLICE) if text else (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            columns, names = list(part.columns), list(part.schema.names)
            if text:
                flat, counts = table.encode(text_column(part, text).to_pylist())
                columns.append(list_array(flat.astype(np.int32), counts, pa.int32()))
                names.append(ids)
            else:
                column = part.column(part.schema.get_field_index(ids))
                flat, counts = np.asarray(column.flatten(), dtype=np.int64), np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
            if decoded:
                columns.append(pa.array(table.model.decode_ids(flat, counts), type=pa.string()))
                names.append(decoded)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return base.mapInArrow(run, _extended(base, ", ".join(added)))


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with a column ``ids`` of array<int>: the piece ids of ``text``, without begin or end ids.

    A column already named ``ids`` is replaced. ``model_path`` must be readable on every executor.
    """
    return _mapped(df, model_path, text, ids, None)


def decode(df: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with a column ``decoded``: the text of ``ids``. Byte pieces that are no UTF-8 become U+FFFD each."""
    return _mapped(df, model_path, None, ids, decoded)


def round_trip(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of what it gave, in one pass."""
    return _mapped(df, model_path, text, ids, decoded)


def _extended(df: DataFrame, more: str):
    from pyspark.sql.types import StructType

    return StructType(df.schema.fields + StructType.fromDDL(more).fields)


def op3_query(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = round_trip(docs, path).drop("text")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
