"""Token counts of whole texts: words are counted once and remembered; huge texts are encoded in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import worker_memory
from phasegrid.llm.common import small_batches, table
from phasegrid.llm.packing import _Memory
from phasegrid.llm.packing import _runs as text_runs

#: Characters of a chunk of a huge text, and of the overlap of two chunks at first.
CHUNK, OVERLAP = 1 << 16, 256
LIMIT = 1024
#: Words, and parts of words, whose counts a worker remembers in each of two generations.
WORDS = 200_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PUNCTUATION = r"!-/:-@\[-`{-~"
#: Between these two characters the vocabulary's splitter always splits, whatever stands around: before white space, and where letters, digits and punctuation change (but an apostrophe may take letters after it).
STABLE = re.compile(rf"(?<=\S)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9{_PUNCTUATION}])|(?<=[0-9])(?=[A-Za-z{_PUNCTUATION}])")
#: A space that may belong to white space before it.
_DOUBLE_SPACE = re.compile(r"\s ")
_SINGLE_SPACE = re.compile(r"(?<=\S) ")
#: Words, and a line break between two: parts that the splitter keeps apart.
_SIMPLE = re.compile(rf"([{_LETTERS}]+)([.,;:!?]*)(?:\n([{_LETTERS}]+)([.,;:!?]*))?")

_known: dict[str, _Counts] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Counts:
    """Numbers of tokens of words and texts. A space after anything but white space starts a word, so a text's tokens are those of its words, each with the space before it."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = max((len(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()), default=0)
        self.words, self.parts = _Memory(WORDS), _Memory(WORDS)

    def starts(self, text: str) -> np.ndarray:
        """First character of each token."""
        return np.array([a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets], np.int64)

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list) -> None:
        """words: keys as count() makes them."""
        self.parts.turn()
        split, rest, wanted = [], [], set()
        for w in words:
            own, space = (w[0], "") if isinstance(w, tuple) else (w, " ")
            if m := _SIMPLE.fullmatch(own):
                parts = [space + m[1], m[2]] if m[3] is None else [space + m[1], m[2], "\n", m[3], m[4]]
                split.append((w, parts))
                wanted.update(parts)
            else:
                rest.append((w, space + own))
        new = list(self.parts.missing(wanted))
        self.parts.young.update(zip(new, self.encoded(new), strict=True))
        find = self.parts.young.__getitem__
        self.words.young.update((w, sum(map(find, parts))) for w, parts in split)
        self.words.young.update(zip([w for w, _ in rest], self.encoded([t for _, t in rest]), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        self.words.turn()
        split = []
        for t in texts:
            words: list = (_SINGLE_SPACE.split if _DOUBLE_SPACE.search(t) else _on_spaces)(t)
            words[0] = (words[0],)  # no space before it
            split.append(words)
        if new := self.words.missing(set().union(*split)):
            self.learn(list(new))
        find = self.words.young.__getitem__
        return [sum(map(find, words)) for words in split]


def _on_spaces(text: str) -> list[str]:
    return text.split(" ")


def spliced(text: str, starts: Callable[[str], np.ndarray], chunk: int = CHUNK, overlap: int = OVERLAP, special: int = 0) -> tuple[int, int]:
    """(tokens, chunks encoded) of a text by overlapping chunks.

    starts: first characters of the tokens of a text; special: length of the longest special string, which the first chunk has to see whole. Two chunks are spliced at the last place in their overlap at which both begin a token and
    the splitter always splits: up to there the first chunk is right, and from there on the second reads the same characters from the same state.
    Without such a place the overlap doubles; once it holds all that the first chunk adds, the first chunk grows instead, up to the whole text.
    """
    n, total, at, end = len(text), 0, 0, min(len(text), chunk)
    own, encoded = starts(text[:end]), 1
    while end < n:
        width = overlap
        while True:
            begin, stop = max(end - width, at), min(n, end + chunk)
            places = np.array([begin + m.start() for m in STABLE.finditer(text[begin:end]) if begin + m.start() <= end - special], np.int64)
            if len(places):
                after = begin + starts(text[begin:stop])
                encoded += 1
                places = np.intersect1d(np.intersect1d(places, own), after)
                if len(places):
                    cut = int(places[-1])
                    total += int(np.searchsorted(own, cut) - np.searchsorted(own, at))
                    own, at, end = after, cut, stop
                    break
            if begin == at:
                end = min(n, at + 2 * (end - at))
                own, encoded = at + starts(text[at:end]), encoded + 1
                break
            width *= 2
    return total + int(len(own) - np.searchsorted(own, at)), encoded


def count_tokens(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_chunks): UTF-8 bytes and tokens of each row's whole text, without begin or end marks; special strings count as the library takes them.

    path: a byte-level vocabulary of the tokenizers library that splits like the default one (letters, digits, others, white space), readable on every
    executor. Texts of more than `chunk` characters are encoded in chunks with `overlap` (n_chunks of them, else 1). Each row is judged by
    itself: no shuffle. Null and empty texts have no tokens; repeated rows give repeated rows, null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from phasegrid.llm import token_counts as here  # the worker's own module, whose memory outlives a task

        worker_memory.start("token_counts", here._known.clear)
        if path not in here._known:
            here._known[path] = here._Counts(path)
        known = here._known[path]
        for b in batches:
            size = pc.binary_length(b.column(1)).fill_null(0)
            for lo, hi in text_runs(b.column(1)):
                texts = [x or "" for x in b.column(1)[lo:hi].to_pylist()]
                huge = {i: spliced(t, known.starts, chunk, overlap, known.special) for i, t in enumerate(texts) if len(t) > chunk}
                n = known.count(["" if i in huge else t for i, t in enumerate(texts)])
                tokens, chunks = [huge[i][0] if i in huge else x for i, x in enumerate(n)], [huge[i][1] if i in huge else 1 for i in range(len(n))]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], size[lo:hi].cast(pa.int64()), pa.array(tokens, pa.int64()), pa.array(chunks, pa.int32())], ["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, n_chunks int")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "n_chunks")


QUERIES = {"op11_token_counts": op11_token_counts}
ORACLES: dict[str, str] = {}
