"""What several operators here share: tables, written intermediates, exact tokenization."""

from __future__ import annotations

import functools
import re
import uuid
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopledger.session import checkpoint_dir, small_batches
from loopledger.sources import tables

__all__ = ["checkpoint_dir", "small_batches", "table", "workspace", "written", "by_key", "Encoder", "encoder", "VOCABULARY", "END"]

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, for a session whose Arrow batches are bounded."""
    small_batches(spark)
    return tables.table(spark, sf_dir, name)


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the storage that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Write a table and read it back: cuts lineage and fixes the rows, also if an executor is lost."""
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join on equal keys of which neither side is broadcast.

    For sides that grow with the input: Spark takes an explode to be as large as what goes into it and a
    written table to be as large as its compressed files, and would send millions of rows through the driver.
    """
    return df.hint("merge")


#: Name of the vocabulary file among the public tokenizers, and the id that ends a document.
VOCABULARY, END = "byte_bpe_50k.json", 0


_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them.

    Byte-level BPE never joins across a single blank or line feed between two characters that are
    not white space, nor a run of letters and a run of marks after it, so texts are cut there.
    Frequent pieces are remembered; the others of many texts are encoded in one call, and their ids
    are told apart by the bytes they stand for.  The memory holds the pieces seen first and starts
    anew after many misses, which costs time only.  A text that holds the name of a special token
    goes to the library whole.
    """

    _near_space = re.compile(r"\s\s")

    def __init__(self, path: str | None = None, memory: int = 1_000_000, patience: int = 8_000_000):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        #: ids come as little-endian integers of this kind
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._bytes = np.zeros(self.size, np.int64)  # a token has one character for each byte
        for token, id_ in vocabulary.items():
            self._bytes[id_] = len(token)
        self._memory, self._patience, self._missed = memory, patience, 0
        # pieces after a blank, pieces after a line feed, and marks after letters -> ids
        self._known: dict[str, bytes] = {}
        self._bare: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}
        self._feed = self._alone(["\n"])[0]

    def _spaced(self, text: str) -> bool:
        """Whether two characters of white space stand side by side."""
        plain = text.replace("\n", " ")
        if plain.isprintable():  # then blanks are its only white space
            return "  " in plain
        return bool(self._near_space.search(text))

    def _alone(self, texts: list[str]) -> list[bytes]:
        encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, self.kind).tobytes() for e in encoded]

    def _together(self, pieces: list[str], before: str) -> list[bytes]:
        """Ids of pieces that each follow a blank, or a line feed, which is no part of the ids then."""
        if not pieces:
            return []
        joined = before + before.join(pieces)
        ids = np.asarray(self._tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
        sizes = map(len, pieces) if joined.isascii() else map(len, map(str.encode, pieces))
        ends = np.cumsum(np.fromiter(sizes, np.int64, len(pieces)) + 1)
        cuts = (np.searchsorted(np.cumsum(self._bytes[ids]), ends, "left") + 1) * self.kind.itemsize
        data, cuts, skip = ids.tobytes(), cuts.tolist(), len(self._feed) if before == "\n" else 0
        return [data[a + skip : b] for a, b in zip([0, *cuts], cuts)]

    def _remember(self, memory: dict[str, bytes], found: dict[str, bytes]) -> None:
        room = self._memory - len(self._known) - len(self._bare)
        if room > 0:
            memory.update(islice(found.items(), room))
        self._missed += len(found)

    def encode_many(self, texts: list[str | None], together: int = 20_000) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers; a null text has none."""
        if self._missed > self._patience:
            self._known, self._bare, self._missed = {}, {}, 0
        known, bare, out, waiting = self._known, self._bare, [], []
        find = known.get
        # unknown pieces after a blank and after a line feed, and those after a blank that are made of others
        new: dict[str, None] = {}
        new_bare: dict[str, None] = {}
        made: dict[str, list] = {}

        def parts_of(piece: str, after_feed: bool) -> list:
            """What gives the ids of a piece: ids, or unknown pieces with whether they follow a line feed."""
            ids = (bare if after_feed else known).get(piece)
            if ids is not None:
                return [ids]
            word = piece.rstrip(_MARKS)
            # letters beyond these blocks may be of another class in another version of Unicode
            if len(word) < len(piece) and word.isalpha() and max(word) < "\u0250":
                marks = piece[len(word) :]
                if marks not in self._marks:
                    if len(self._marks) > 10_000:
                        self._marks.clear()
                    self._marks[marks] = self._alone([marks])[0]
                return [*parts_of(word, after_feed), self._marks[marks]]
            (new_bare if after_feed else new)[piece] = None
            return [(piece, after_feed)]

        def finish() -> None:
            found = dict(zip(new, self._together(list(new), " ")))
            found_bare = dict(zip(new_bare, self._together(list(new_bare), "\n")))
            for piece, parts in made.items():
                found[piece] = b"".join([
                    x if isinstance(x, bytes) else (found_bare if x[1] else found)[x[0]] for x in parts])
            heads = iter(self._alone([head for head, _, _ in waiting]))
            for _, ids, later in waiting:
                for k, piece in later:
                    ids[k] = found[piece]
                out.append(next(heads) + b"".join(ids))
            self._remember(known, found)
            self._remember(bare, found_bare)
            for done in (waiting, made, new, new_bare):
                done.clear()

        for text in texts:
            if not text:
                waiting.append(("", [], []))
            elif text[0].isspace() or text[-1].isspace() or self._spaced(text) or any(s in text for s in self._special):
                waiting.append((text, [], []))
            else:
                head, *parts = text.split(" ")
                ids = list(map(find, parts))
                later = [(k, parts[k]) for k, i in enumerate(ids) if i is None] if None in ids else []
                for _, piece in later:
                    if piece.isalpha():
                        new[piece] = None
                    elif piece not in made and piece not in new:
                        first, *rest = piece.split("\n")
                        own = parts_of(first, False)
                        for r in rest:
                            own += [self._feed, *parts_of(r, True)]
                        if own != [(piece, False)]:
                            made[piece] = own
                waiting.append((head, ids, later))
            if len(new) + len(new_bare) > together:
                finish()
        finish()
        return out


@functools.cache
def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def with_row_ids(df: DataFrame, name: str) -> DataFrame:
    """Number rows by their place in the input's partitions; fix them with written() before a join."""
    return df.withColumn(name, F.monotonically_increasing_id())


def only_rows(df: DataFrame, name: str, chosen: DataFrame) -> DataFrame:
    """Rows of df whose number, in column `name`, is among the one column of chosen; df stays where it is read.

    The chosen numbers are sent to the tasks as bits: with numbers of with_row_ids(), 4 KB for 32,768
    rows, and at least 4 KB for each task that numbered rows.
    """
    at = chosen.select(F.col(chosen.columns[0]).alias("at")).withColumn("bucket", F.bitmap_bucket_number("at"))
    # dealt by bucket first: a task holds the bits of its own buckets only, and numbers move, not bits
    bits = at.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    place = F.bitmap_bit_position(df[name])
    byte = F.conv(F.hex(F.substring(bits["bits"], F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1
    return df.join(F.broadcast(bits), (F.bitmap_bucket_number(df[name]) == bits["bucket"]) & held, "left_semi")


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete intermediates of one's own that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
