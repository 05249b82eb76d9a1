"""Helpers shared by the operators: tables, the shared folder, a cached encoder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this package.
BLANK = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str | Column) -> Column:
    """The text as it is; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``; a local master may go without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = f"file://{tempfile.mkdtemp(prefix='codecairn-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and leaves a plain scan, so that
    a later join has an exchange directly below it on both sides and adaptive
    execution can split a hot key.
    """
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers."""
    from codecairn.session import attach

    attach(spark)


# A cut between a non-blank and one space before a non-blank: no pre-token of the
# byte-level pattern crosses it, and the space opens the next one.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_ODD = re.compile(r"\s\s|\A\s|\s\Z|\x00")


def space_led_words(text: str) -> list[str]:
    """Cut a text where byte-level pre-tokenization certainly cuts too.

    Pieces keep their leading space; joined they are the text.  Encoding each
    piece alone gives the ids of the whole text.
    """
    if not text:
        return []
    if _ODD.search(text):
        return _CUT.split(text)
    return text.replace(" ", "\x00 ").split("\x00")


def folded_lines(text: str) -> str:
    """A text to be cut at its spaces, for vocabularies that fold case and drop white space.

    Texts of Latin-1 characters are folded first: for them folding is the same
    before and after cutting, and more words are equal.
    """
    try:
        text.encode("latin-1")
        text = text.lower()
    except UnicodeEncodeError:
        pass
    return text.replace("\n", " ")


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """One tokenizer per file and process; special strings in a text are ordinary text."""
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _tokenizers[path] = made
    return _tokenizers[path]


#: Characters of the texts whose words are looked up together.
SLICE = 1_000_000
#: Marks that are a pre-token of their own when they end a word after a letter.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# White space and controls, a little more than any regular expression counts as white space.
_SPACE = r"[\x00-\x20\x7f-\x{a0}\pZ]"
_ODD_TEXT = rf"{_SPACE}{_SPACE}|\A{_SPACE}|{_SPACE}\z|\x00"
# A line feed between two other characters is a byte-level pre-token of its own, too.
_CUT_LINES = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_LATIN = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]"


def _split(texts: list[str], cut: str) -> pa.Array:
    """Lists of pieces between the cuts, and before the marks that end a piece after a letter."""
    column = pc.replace_substring_regex(pa.array(texts, pa.large_string()), f"({_LATIN})([{re.escape(_MARKS)}]+)({cut}|\\z)", rf"\1{cut}\2\3")
    return pc.split_pattern(column, cut)


def _space_led_pieces(texts: list[str]) -> pa.Array:
    """Lists of pieces, cut where byte-level pre-tokenization cuts; texts hold no zero character."""
    odd = pc.match_substring_regex(pa.array(texts, pa.large_string()), _ODD_TEXT).to_pylist()
    marked = [
        _CUT_LINES.sub("\x00", text) if slow else text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00")
        for text, slow in zip(texts, odd)
    ]
    return _split(marked, "\x00")


def _bare_pieces(texts: list[str]) -> pa.Array:
    return _split([folded_lines(text) for text in texts], " ")


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > SLICE:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


class WordEncoder:
    """Ids of whole texts, each distinct word encoded once while it stays cached.

    ``ids`` gives little-endian unsigned integers of ``width`` bytes, joined.
    The words of a slice of texts are cut and told apart by Arrow; only distinct
    ones are looked up, and their ids are laid out by numpy.  The cache is emptied
    when it holds ``limit`` words, which bounds the memory of a worker and changes
    no result.
    """

    def __init__(self, path: str, space_led: bool, width: int = 4, limit: int = 600_000):
        self.path, self.width, self.limit = path, width, limit
        self.pieces = _space_led_pieces if space_led else _bare_pieces
        self.cache: dict[str, bytes] = {}
        whole = tokenizer(path)
        size = whole.get_vocab_size(with_added_tokens=True)
        self.names = [i.to_bytes(width, "little") for i in range(size)]
        tokens = [whole.id_to_token(i) or "" for i in range(size)]
        # ids that end a word, in vocabularies that mark the end
        ends = [t.endswith("</w>") for t in tokens]
        self.ends = np.array(ends) if any(ends) and not space_led else None
        # ids that begin with a space, in byte-level vocabularies
        starts = [t.startswith("\u0120") for t in tokens]
        self.starts = np.array(starts) if any(starts) and space_led else None
        # words that are one pre-token and pass the normalizer as they are
        self.plain = re.compile(" [A-Za-z]+" if self.starts is not None else "[a-z]+").fullmatch
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer(whole.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")

    def _learn(self, words: list[str]) -> None:
        """Encode new words; one that ends in marks is its stem's ids and the marks'."""
        cache, name = self.cache, self.names.__getitem__
        plain = list(filter(self.plain, words)) if self.starts is not None or self.ends is not None else []
        for at in range(0, len(plain), 4096):
            self._learn_plain(plain[at : at + 4096])
        marked, new = [], set()
        for w in words:
            if w in cache:
                continue
            stem = w.rstrip(_MARKS)
            # folding may turn a letter into a letter and an accent, which joins the mark
            if len(stem) < len(w) and stem[-1:].lower().isalpha():
                marks = w[len(stem) :]
                marked.append((w, stem, marks))
                new |= {stem, marks}
            else:
                new.add(w)
        new = list(new.difference(cache))
        for at in range(0, len(new), 4096):
            part = self._learn_together(new[at : at + 4096])
            encoded = tokenizer(self.path).encode_batch_fast(part, add_special_tokens=False)
            for word, code in zip(part, encoded):
                cache[word] = b"".join(map(name, code.ids))
        for w, stem, marks in marked:
            cache[w] = cache[stem] + cache[marks]

    def _learn_plain(self, words: list[str]) -> None:
        """Words of plain letters are one pre-token, so the vocabulary's model alone encodes them."""
        lines = "\n".join(words).replace(" ", "\u0120")
        self._keep(words, self.model.encode_batch_fast([lines], add_special_tokens=False)[0].ids)

    def _learn_together(self, words: list[str]) -> list[str]:
        """Encode words of letters only, or words with one space, as one text and cut it where they end.

        Returns the words that are left to be encoded one by one.
        """
        if self.starts is None and self.ends is None:
            return words
        if self.starts is not None:
            # a space in front and no other: joined they are cut as texts are, before each space
            joined = [w for w in words if len(w) > 1 and w[0] == " " and w.count(" ") == 1 and not w[1].isspace() and not w[-1].isspace()]
            text = "".join(joined)
        else:
            joined = [w for w in words if w.isalpha()]
            text = " ".join(joined)
        if not joined:
            return words
        self._keep(joined, tokenizer(self.path).encode_batch_fast([text], add_special_tokens=False)[0].ids)
        return [w for w in words if w not in self.cache]

    def _keep(self, words: list[str], ids: list[int]) -> None:
        """Cache the ids of words encoded as one text, if as many are found in it."""
        ids = np.array(ids)
        if self.starts is not None:
            first = np.flatnonzero(self.starts[ids])
        else:  # folding may make more than letters of a word
            first = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])[:-1]
        if len(first) != len(words) or first[0] != 0:
            return
        raw = ids.astype(f"<u{self.width}").tobytes()
        cuts = (first * self.width).tolist()
        for word, a, b in zip(words, cuts, [*cuts[1:], len(raw)]):
            self.cache[word] = raw[a:b]

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        for part in _slices(texts):
            whole = [k for k, text in enumerate(part) if "\x00" in text]
            if not whole:
                yield from self._of_slice(part)
                continue
            out = list(self._of_slice(["" if "\x00" in text else text for text in part]))
            encoded = tokenizer(self.path).encode_batch_fast([part[k] for k in whole], add_special_tokens=False)
            for k, code in zip(whole, encoded):
                out[k] = b"".join(map(self.names.__getitem__, code.ids))
            yield from out

    def _of_slice(self, texts: list[str]) -> Iterator[bytes]:
        pieces = self.pieces(texts)
        words = pieces.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        missing = [w for w in distinct if w not in self.cache]
        if len(self.cache) + 2 * len(missing) > self.limit:
            self.cache.clear()
            missing = distinct
        self._learn(missing)
        codes = [self.cache[w] for w in distinct]
        n = np.fromiter(map(len, codes), np.int64, len(codes)) // self.width
        first, word = np.cumsum(n) - n, words.indices.to_numpy()
        n_of = n[word]
        ends = np.cumsum(n_of)
        store = np.frombuffer(b"".join(codes), f"<u{self.width}")
        raw = store[np.repeat(first[word] - (ends - n_of), n_of) + np.arange(int(n_of.sum()))].tobytes()
        at = np.concatenate([[0], ends])[pieces.offsets.to_numpy()] * self.width
        for a, b in pairwise(at.tolist()):
            yield raw[a:b]


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, space_led: bool, width: int = 4) -> WordEncoder:
    """The encoder of this process, kept between tasks of a reused worker."""
    key = (path, space_led, width)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, space_led, width)
    return _encoders[key]


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
