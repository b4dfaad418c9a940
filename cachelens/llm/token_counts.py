"""Token counts through a digest cache.

Texts are normalised in a way that cannot change the count (a null text is an empty one), digested, and
joined with the stored counts of the same tokenizer version.  Only distinct digests without a stored count
are encoded; their counts are appended to the cache, from which every document then takes its count.

The cache is a Parquet table ``tokenizer string, digest string, n_bytes long, n_tokens long`` in the shared folder, with one
sub-folder for each tokenizer digest, so that another vocabulary file or another option never meets old counts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm.common import dropped, release, workspace, written

#: The encoder's version: a change of the counting rules must change it.
RULES = "1"


class ByteBpe:
    """Counts of a byte-level BPE ``.json`` file as the tokenizers library gives them.

    The vocabulary is loaded into tiktoken, whose merge loop gives the same ids several times faster; special
    strings inside a text count as one token each, as they do by default in the tokenizers library.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        if spec["model"]["type"] != "BPE" or spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = byte_of_symbol()
        ranks = {bytes(to_byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
        # The published pattern of this kind of pre-tokenizer.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.special = list(special)
        self.core = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def count(self, text: str) -> int:
        n, parts = 0, [text]
        for s in self.special:
            if s in text:
                parts = [q for p in parts for q in p.split(s)]
        n += len(parts) - 1
        return n + sum(len(self.core.encode_ordinary(p)) for p in parts)


class Pieces:
    """Counts of a sentencepiece ``.model`` file by the sentencepiece library itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text, num_threads=1))


class AnyJson:
    """Counts of any other ``.json`` file by the tokenizers library itself."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)


def byte_of_symbol() -> dict[str, int]:
    """The printable symbol of each byte in byte-level vocabularies, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_loaded: dict[str, object] = {}


def counter(path: str):
    """The counter for a vocabulary file, kept for the life of a Python worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            _loaded[path] = Pieces(path)
        else:
            try:
                _loaded[path] = ByteBpe(path)
            except (ValueError, KeyError, TypeError):
                _loaded[path] = AnyJson(path)
    return _loaded[path]


def resolve(tokenizer: str) -> str:
    """A file's place on this machine: an absolute path as it is, else a name of the public tokenizers."""
    if tokenizer.startswith("/"):
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def tokenizer_digest(tokenizer: str) -> str:
    """Digest of the vocabulary file's bytes and of the counting rules."""
    return hashlib.sha256(open(resolve(tokenizer), "rb").read() + RULES.encode()).hexdigest()[:32]


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache: str | None = None, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (``doc_id``, ``text``).

    Args:
        tokenizer: file name of the public tokenizers, or an absolute path present on every machine.
        cache: folder of the digest cache; None starts an empty one in the shared folder.
        limit: ``over_limit`` is ``n_tokens > limit``.

    A null text counts as empty (0 bytes, 0 tokens); a null ``doc_id`` keeps its row; repeated rows each get one; an empty
    table gives an empty result; other columns are ignored, whatever their names.  Texts are never cut.
    Equal texts are encoded once, however many rows hold them: rows are first combined by digest on the map side,
    so a text that fills a third of the table never meets in one task.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    home = f"{cache or workspace(spark, 'token-cache')}/tokenizer={version}"
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2("text", 256).alias("digest")
    known = stored(spark, home)
    # One representative row per digest, named by its id; ids may repeat or be null, so the text decides afterwards.
    work = workspace(spark, "token-counts")
    first = docs.select(digest, F.coalesce("doc_id", F.lit(-(2**63))).alias("rep")).groupBy("digest").agg(F.min("rep").alias("rep"))
    first = written(first, f"{work}/digests")
    misses = first.join(known.select("digest"), "digest", "left_anti").select("digest", "rep")
    # The id is unique per row in a sound table, so this join spreads evenly even where one text fills a third of it.
    todo = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("rep"), "text").join(misses, "rep").where(F.sha2("text", 256) == F.col("digest")).select("digest", "text")
    encoded = todo.mapInArrow(_encoder(tokenizer), "digest string, n_bytes long, n_tokens long")
    encoded.dropDuplicates(["digest"]).write.mode("append").parquet(home)
    release(spark)
    # the counts of these digests alone, written before they are joined, so that Spark can split a text that very many rows hold
    counts = written(first.select("digest").join(stored(spark, home), "digest"), f"{work}/counts")
    dropped(spark, f"{work}/digests")
    return docs.select("doc_id", digest).join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def stored(spark: SparkSession, home: str) -> DataFrame:
    """The cache of one tokenizer version, one row per digest, however often runs appended it; empty when nothing has been written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(home)
    schema = "digest string, n_bytes long, n_tokens long"
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(home).dropDuplicates(["digest"])


def clear_cache(spark: SparkSession, cache: str) -> None:
    """Forget every stored count below ``cache``."""
    dropped(spark, cache)


def _encoder(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, last = counter(resolve(tokenizer)).count, None
        for b in batches:
            digests, n_bytes, n_tokens = [], [], []
            for d, t in zip(b.column("digest").to_pylist(), b.column("text")):
                if d == last:  # rows that share id and text follow each other
                    continue
                last, t = d, t.as_py()
                digests.append(d)
                n_bytes.append(len(t.encode()))
                n_tokens.append(count(t))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["digest", "n_bytes", "n_tokens"])

    return run
