"""Encoding with a public byte-level BPE vocabulary, by Spark's higher-order functions."""

import base64
import json
import os
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.session import spread, written

#: Where the vocabulary files lie, unless the caller says otherwise.
TOKENIZERS = os.environ.get("FOLIOSPARK_TOKENIZERS", "/opt/tokenizers")
# Fixed value: the pattern that splits text before the merges; (?U) gives white space its Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same matches, the commonest alternatives first and without backtracking, for Java.
JAVA_PATTERN = r"(?U) ?\p{L}++| ?\p{N}++|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Words of a document that are handled in one row.
SEGMENT = 1024
#: Bytes from which a word is cut where no piece of the vocabulary can span the cut.
LONG = 24
#: Two primes whose product exceeds every pair of ids, as a key; the first is the size of the rank table.
SLOTS, SPREAD = 131_071, 19_997
#: Between the values of a literal; no piece of text in the vocabulary holds it.
SEPARATOR = "\ue000"
#: Slots of the table of whole words, a power of two.
WORD_SLOTS = 131_072


class Vocabulary:
    """Merges and pieces of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        byte_of = self.byte_letters()
        spell = lambda piece: bytes(byte_of[c] for c in piece)
        special = [p for p in model["vocab"] if any(c not in byte_of for c in p)]
        self.id_of = {spell(p): i for p, i in model["vocab"].items() if p not in special and p != "<|endoftext|>"}
        self.piece_of = {i: p for p, i in self.id_of.items()}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        #: (left id, right id) -> (rank, id of the merged piece)
        self.ranks = {(self.id_of[spell(a)], self.id_of[spell(b)]): (r, self.id_of[spell(a + b)]) for r, (a, b) in enumerate(merges)}
        self.first = [self.id_of[bytes([b])] for b in range(256)]
        self.size = max(self.piece_of) + 1

    @staticmethod
    def byte_letters() -> dict[str, int]:
        """The letter that stands for each byte in the file: printable bytes for themselves, the rest from U+0100 on."""
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}

    def encode_word(self, word: bytes) -> list[int]:
        """Merge one word on the driver, lowest rank first: for building tables and for tests."""
        ids = [self.first[b] for b in word]
        while len(ids) > 1:
            best = min((self.ranks[p] + p for p in zip(ids, ids[1:]) if p in self.ranks), default=None)
            if best is None:
                break
            _, new, a, b = best
            out, i = [], 0
            while i < len(ids):
                if ids[i] == a and ids[i + 1 : i + 2] == [b]:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids


def perfect_table(keys: dict[int, int], slots: int, spread: int) -> tuple[list[int | None], list[int]]:
    """A table without collisions: key k lies at (k mod slots + shift[k mod spread]) mod slots."""
    groups: dict[int, list[int]] = defaultdict(list)
    for k in keys:
        groups[k % spread].append(k)
    table: list[int | None] = [None] * slots
    shifts = [0] * spread
    for g, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
        homes = [k % slots for k in members]
        shift = next(s for s in range(slots) if all(table[(h + s) % slots] is None for h in homes))
        shifts[g] = shift
        for k, h in zip(members, homes):
            table[(h + shift) % slots] = keys[k]
    return table, shifts


@cache
def _tables(path: str) -> tuple[int, dict[str, tuple[str, str]]]:
    """The vocabulary's size; values (joined) and type of the rank table, the bytes' ids, the cuts and the words of the vocabulary."""
    import xxhash

    v = Vocabulary(path)
    packed = {a * v.size + b: (rank << 32) | (a * v.size + b) for (a, b), (rank, _) in v.ranks.items()}
    ranks, shifts = perfect_table(packed, SLOTS, SPREAD)
    merged = [new for _, new in sorted(v.ranks.values())]
    spans = {x for piece in v.id_of for x in zip(piece, piece[1:])}
    cuts = [int((a, b) not in spans) for a in range(256) for b in range(256)]
    words: list[str | None] = [None] * WORD_SLOTS
    ids = [-1] * WORD_SLOTS
    for i, piece in sorted(v.piece_of.items()):
        # A later word whose two slots are taken is left to the fold, which gives the same.
        sign = xxhash.xxh64_intdigest(piece, seed=42)
        slot = next((x for x in (sign % WORD_SLOTS, sign // WORD_SLOTS % WORD_SLOTS) if words[x] is None), None)
        if slot is not None and piece.decode("utf-8", "ignore").encode() == piece and v.encode_word(piece) == [i]:
            words[slot], ids[slot] = piece.decode("utf-8"), i
    # Numbers of up to four digits that take two pieces are known words too, numbered from the vocabulary's size.
    numbers = [f"{space}{n:0{digits}}" for digits in range(1, 5) for n in range(10**digits) for space in ("", " ")]
    twos = []
    for text in numbers:
        pair = v.encode_word(text.encode())
        sign = xxhash.xxh64_intdigest(text, seed=42)
        slot = next((x for x in (sign % WORD_SLOTS, sign // WORD_SLOTS % WORD_SLOTS) if words[x] is None), None)
        if len(pair) == 2 and slot is not None:
            words[slot], ids[slot] = text, v.size + len(twos)
            twos.append(pair)
    lists: dict[str, tuple[list, str]] = {
        "lefts": ([a for a, _ in twos] or [0], "int"),
        "rights": ([b for _, b in twos] or [0], "int"),
        "ranks": ([0 if r is None else r for r in ranks], "bigint"),
        "shifts": (shifts, "int"),
        "merged": (merged, "int"),
        "first": (v.first, "int"),
        "cuts": (cuts, "int"),
        "words": (words, "string"),
        "word_ids": (ids, "int"),
    }
    return v.size, {name: (SEPARATOR.join("" if x is None else str(x) for x in values), kind) for name, (values, kind) in lists.items()}


def let(value: Column, body) -> Column:
    """``body`` of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Literals:
    """The tables as literals of a plan, whose size the vocabulary fixes.

    Each is a string that the optimizer splits and casts once.  Plans that hold them are shown cut short.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.size, self.tables = _tables(path)
        if spark.conf.get("spark.sql.maxPlanStringLength").startswith("2147483"):  # its default: no limit
            spark.conf.set("spark.sql.maxPlanStringLength", "1000000")

    def __call__(self, name: str) -> Column:
        joined, kind = self.tables[name]
        parts = F.split(F.lit(joined), SEPARATOR)
        return parts if kind == "string" else parts.cast(f"array<{kind}>")


def known_ids(words: Column, pieces: Column, ids: Column) -> Column:
    """Of each word its id if it is found to be one piece of the vocabulary, a number's code if it is one of two, else null."""
    sign = F.xxhash64
    slot = lambda h: h.bitwiseAND(F.lit(WORD_SLOTS - 1)).cast("int")
    one, other = lambda w: slot(sign(w)), lambda w: slot(F.shiftrightunsigned(sign(w), 17))
    return F.transform(words, lambda w: F.when(F.get(pieces, one(w)) == w, F.get(ids, one(w))).when(F.get(pieces, other(w)) == w, F.get(ids, other(w))))


def fold(ids: Column, ranks: Column, shifts: Column, merged: Column, size: int) -> Column:
    """Apply the merges to a word's ids: in each round the pair of lowest rank, wherever it stands."""

    def rank(a: Column, b: Column) -> Column:
        key = a.cast("bigint") * F.lit(size) + b
        slot = lambda k: ((k % F.lit(SLOTS) + F.get(shifts, (k % F.lit(SPREAD)).cast("int"))) % F.lit(SLOTS)).cast("int")
        return let(key, lambda k: let(F.get(ranks, slot(k)), lambda found: F.when(found.bitwiseAND(F.lit(0xFFFFFFFF)) == k, found)))

    def lowest(x: Column) -> Column:
        return F.array_min(F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), rank))

    def merge(x: Column, a: Column, b: Column, new: Column) -> Column:
        apart = F.filter(
            F.transform(x, lambda y, i: F.when((y == a) & (F.get(x, i + 1) == b), new).when((y == b) & (F.get(x, i - 1) == a), F.lit(-1)).otherwise(y)),
            lambda y: y >= 0,
        )
        twins = F.aggregate(
            x,
            F.array().cast("array<int>"),
            lambda out, y: F.when((y == a) & (F.try_element_at(out, F.lit(-1)) == a), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(new))).otherwise(F.concat(out, F.array(y))),
        )
        return F.when(a == b, twins).otherwise(apart)

    def step(state: Column) -> Column:
        key = state["best"].bitwiseAND(F.lit(0xFFFFFFFF))
        pair = F.struct(F.floor(key / F.lit(size)).cast("int").alias("a"), (key % F.lit(size)).cast("int").alias("b"), F.get(merged, F.shiftright(state["best"], 32).cast("int")).alias("new"))
        after = let(pair, lambda p: merge(state["ids"], p["a"], p["b"], p["new"]))
        return let(after, lambda x: F.struct(x.alias("ids"), lowest(x).alias("best")))

    start = F.struct(ids.alias("ids"), lowest(ids).alias("best"))
    rounds = F.sequence(F.lit(1), F.greatest(F.size(ids) - 1, F.lit(1)))
    return F.aggregate(rounds, start, lambda state, _: F.when(state["best"].isNull(), state).otherwise(step(state)), lambda state: state["ids"])


def word_ids(word: Column, tables: Literals) -> Column:
    """All ids of a word: its bytes folded; long words are first cut where no piece can span the cut."""

    def of(codes: Column, ranks: Column, shifts: Column, merged: Column, first: Column, cuts: Column) -> Column:
        whole = lambda part: fold(F.transform(part, lambda b: F.get(first, b)), ranks, shifts, merged, tables.size)
        n = F.size(codes)
        at = F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get(cuts, F.get(codes, i - 1) * 256 + F.get(codes, i)) == 1)
        parts = let(F.concat(F.array(F.lit(0)), at), lambda starts: F.zip_with(starts, F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(n)), lambda a, b: F.slice(codes, a + 1, b - a)))
        return F.when(n < LONG, whole(codes)).otherwise(F.flatten(F.transform(parts, whole)))

    spelled = F.hex(word.cast("binary"))
    codes = F.transform(F.sequence(F.lit(0), F.greatest(F.octet_length(word) - 1, F.lit(0))), lambda i: F.conv(F.substring(spelled, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return let(
        codes,
        lambda c: let(
            tables("ranks"),
            lambda ranks: let(tables("shifts"), lambda shifts: let(tables("merged"), lambda merged: let(tables("first"), lambda first: let(tables("cuts"), lambda cuts: of(c, ranks, shifts, merged, first, cuts))))),
        ),
    )


def encode(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """The token ids of every row's text: the key and ``ids``, without special tokens.

    A text is cut into words by the vocabulary's pattern.  Words that are one piece, and short numbers that
    are two, are looked up at once; of the others every distinct one is folded once, over its bytes, and its ids go back to the texts that
    hold it.  A text is handled in segments, so no row or group grows with more than one text.

    An empty and a null text both give an empty list; a null key is kept; repeated rows come out repeated.
    Other columns are dropped.
    """
    spark = df.sparkSession
    tables = Literals(spark, path or f"{TOKENIZERS}/byte_bpe_50k.json")
    words = F.coalesce(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(JAVA_PATTERN), F.lit(0)), F.array().cast("array<string>"))
    segments = F.transform(
        F.sequence(F.lit(0), F.floor(F.greatest(F.size("words") - 1, F.lit(0)) / F.lit(SEGMENT)).cast("int")),
        lambda s: F.slice("words", s * SEGMENT + 1, F.lit(SEGMENT)),
    )
    known = let(tables("words"), lambda w: let(tables("word_ids"), lambda i: known_ids(F.col("words"), w, i)))
    unknown = lambda ids: F.array_distinct(F.filter("words", lambda w, i: F.get(ids, i).isNull()))
    coded = lambda ids, rest: F.zip_with("words", ids, lambda w, i: F.coalesce(i, -F.array_position(rest, w).cast("int")))
    split = let(known, lambda ids: let(unknown(ids), lambda rest: F.struct(rest.alias("open"), coded(ids, rest).alias("codes"))))
    found = (
        spread(df.select(F.col(f"`{key}`"), F.col(f"`{text}`"))).select(F.col(f"`{key}`").alias("key"), words.alias("words"), F.monotonically_increasing_id().alias("row"))
        .select("row", "key", F.posexplode(segments).alias("segment", "words"))
        .select("row", "key", "segment", split.alias("split"))
        .select("row", "key", "segment", "split.open", "split.codes")
    )
    found = written(found)
    rest = found.select("row", "segment", F.posexplode("open").alias("at", "word"))
    folded = rest.select("word").distinct().select("word", word_ids(F.col("word"), tables).alias("piece_ids"))
    filled = rest.join(folded, "word").select("row", F.lit(None).cast(df.schema[key].dataType).alias("key"), "segment", F.lit(None).cast("array<int>").alias("codes"), F.struct("at", "piece_ids").alias("word"))
    plain = found.select("row", "key", "segment", "codes", F.lit(None).cast(filled.schema["word"].dataType).alias("word"))
    both = plain.unionByName(filled).repartition("row")
    segment = both.groupBy("row", "segment").agg(
        F.max("key").alias("key"), F.max("codes").alias("codes"), F.transform(F.sort_array(F.collect_list("word")), lambda w: w["piece_ids"]).alias("own")
    )
    size = tables.size

    def spelled(own: Column, lefts: Column, rights: Column) -> Column:
        pair = lambda c: F.array(F.get(lefts, c - size), F.get(rights, c - size))
        return F.flatten(F.transform("codes", lambda c: F.when(c < 0, F.get(own, -c - 1)).when(c < size, F.array(c)).otherwise(pair(c))))

    ids_of = let(F.col("own"), lambda own: let(tables("lefts"), lambda lefts: let(tables("rights"), lambda rights: spelled(own, lefts, rights))))
    whole = segment.select("row", "key", F.struct("segment", ids_of.alias("ids")).alias("part")).groupBy("row").agg(F.max("key").alias("key"), F.collect_list("part").alias("parts"))
    return whole.select(F.col("key").alias(key), F.flatten(F.transform(F.sort_array("parts"), lambda p: p["ids"])).alias(ids))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """``df`` with the text of its ids, by concatenating the pieces' bytes.

    Ids outside the vocabulary stand for nothing; a null list gives a null text.  Bytes that aren't UTF-8
    come out as the replacement character.
    """
    v = Vocabulary(path or f"{TOKENIZERS}/byte_bpe_50k.json")
    pieces = [v.piece_of[i].hex() if i in v.piece_of else None for i in range(v.size)]
    table = F.split(F.lit(",".join(p or "" for p in pieces)), ",")
    spelled = let(table, lambda p: F.array_join(F.transform(F.col(ids), lambda i: F.coalesce(F.get(p, i), F.lit(""))), ""))
    return df.withColumn(text, F.unhex(spelled).cast("string"))


def count_tokens(df: DataFrame, path: str | None = None, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """``df`` with the number of tokens of each text, where only numbers are wanted.

    Each task counts every word it meets once, and keeps the counts, up to a bound, for the next text.  A
    null text has no tokens.
    """
    place = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

    @F.pandas_udf("int")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import regex
        import tiktoken

        with open(place, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        words = regex.compile(PATTERN.removeprefix("(?U)"))
        coder = tiktoken.Encoding("own", pat_str=words.pattern, mergeable_ranks=ranks, special_tokens={})
        sizes: dict[str, int] = {}
        for batch in batches:
            out = []
            for value in batch:
                if not value:
                    out.append(0)
                    continue
                found = words.findall(value)
                for w in set(found).difference(sizes):
                    sizes[w] = len(coder.encode_ordinary(w))
                out.append(sum(map(sizes.__getitem__, found)))
                if len(sizes) > 500_000:
                    sizes.clear()
            yield pd.Series(out, dtype="int32")

    return df.withColumn(tokens, counted(F.col(f"`{text}`")))
