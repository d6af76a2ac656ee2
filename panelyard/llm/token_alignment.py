"""Alignment of two tokenizers' tokens over a corpus, each distinct text once.

1. Texts are shuffled by their whole text and counted, so a text is tokenised and aligned once however often it occurs.
2. Both vocabularies encode the text, tokens become byte ranges, and every stretch between two neighbouring ends is one
   link of an A token and a B token; ends in common cut groups. White space behind other signs begins a token in both
   vocabularies, so texts are worked on in stretches of white space and the signs behind it, and the alignment of stretches
   that come again is kept in a worker (``KEPT`` of them and ``KEPT_BYTES`` at most). Where a vocabulary has a piece with a
   blank behind other signs, whole texts are encoded.
3. The links of id pairs are summed over all texts, each times its multiplicity.
4. A text's measures need the sums of its own pairs. Those of the ``COMMON`` most frequent pairs are sent to the tasks; all
   others, whose rows are rare by that, are joined by pair.
5. Measures go back to the rows by the text's sha256. Texts that make up more than one ``HOT_SHARE``-th of the rows, which are
   fewer than ``HOT_SHARE``, are sent along; the others are joined, so no key of that join has more rows than that share.

Defined results. Null and empty texts, and texts whose bytes a tokenizer doesn't keep, have no tokens: zeros and an empty
digest. Repeated rows and null ids are rows like others. Empty tables give an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import id_and_text, per_text, ranges, raw, slices
from panelyard.session import cut_lineage

#: Distinct stretches, and bytes of them, whose alignment a worker keeps.
KEPT, KEPT_BYTES = 500_000, 16 << 20
#: Stretches that are encoded together and that a long text is worked on at a time; characters of texts that are split at once.
JOINT, PART, AT_ONCE = 2000, 1 << 16, 1 << 22
#: Pairs whose sums are sent to all tasks; share of the rows that makes a text's rows a hot key.
COMMON, HOT_SHARE = 1 << 18, 1000
#: Links summed in a task before sums are sent on.
SUMMED = 1 << 20
#: Unicode white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ACROSS = re.compile(f"[^{_SPACE}][{_SPACE}]")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves,
    the others, in order, for the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words:
    """Ids and token bytes of both vocabularies."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, size = byte_alphabet(), self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.bytes_a = [bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries]
        self.bytes_b = [self.piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.size_b = len(self.bytes_b)
        self.blank = self.b.piece_to_id("▁")
        # white space that longer pieces hold besides blanks (as line ends behind brackets) doesn't end a stretch
        pieces = [self.b.id_to_piece(i).replace("▁", " ") for i in range(self.size_b)]
        joined = {c for p in pieces if len(p) > 1 and not p.startswith("<0x") for c in re.findall(f"[{_SPACE}]", p)} - {" "}
        behind = f"(?:[{''.join(map(re.escape, sorted(joined)))}][{_SPACE}]*[^{_SPACE}]*)*" if joined else ""
        self.stretch = re.compile(f"[{_SPACE}]*[^{_SPACE}]+{behind}|[{_SPACE}]+")
        whole = any(re.search("[^ ] ", p) for p in pieces) or any(_ACROSS.search(e.decode(errors="replace")) for e in self.bytes_a)
        self.parted = not whole and self.bytes_b[self.blank] == b" "

    @staticmethod
    def piece_bytes(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with white space; B puts a blank in front of what it gets."""
        a = [x.ids for x in self.a.encode_batch_fast(stretches, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)

        def own(s: str, ids: list[int]) -> list[int] | None:
            if s[0] == " ":
                return ids or [self.blank]  # nothing gets no blank in front
            return ids[1:] if ids[:1] == [self.blank] else None

        return a, [own(s, ids) for s, ids in zip(stretches, b, strict=True)]


class Aligned:
    """Alignment of stretches, kept by number: sizes, digest text, and the codes of their links one after another."""

    def __init__(self, words: Words):
        self.words = words
        self.size_of = [np.array([len(x) for x in side], np.int64) for side in (words.bytes_a, words.bytes_b)]
        ids = range(max(map(len, self.size_of)))
        self.told = [f"{i}{sign}" for sign in ",|;" for i in ids]
        self.clear()

    def clear(self):
        self.place, self.groups, self.held = {}, [], 0
        self.n = np.zeros((1024, 5), np.int64)  # tokens of A and of B, groups, links (-1: bytes differ), first code
        self.codes, self.used = np.zeros(1 << 16, np.int64), 0

    @staticmethod
    def room(values: np.ndarray, size: int) -> np.ndarray:
        if size <= len(values):
            return values
        return np.concatenate([values, np.zeros((max(size, 2 * len(values)) - len(values), *values.shape[1:]), values.dtype)])

    def align(self, stretches: list[bytes], a: list[int], b: list[int] | None):
        """Of neighbouring stretches and the ids of both sides over all of them: (tokens of A, of B, groups, links) of each,
        digest texts and link codes. None where bytes differ or a token crosses the end of a stretch."""
        words, known = self.words, b"".join(stretches)
        if b is None or b"".join([words.bytes_a[i] for i in a]) != known or b"".join([words.bytes_b[i] for i in b]) != known:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_of[0][a]), np.cumsum(self.size_of[1][b])
        ends = np.unique(np.concatenate([ends_a, ends_b]))  # each stretch between ends lies in one token of either side
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        common = ends[(ends_a[at_a] == ends) & (ends_b[at_b] == ends)]
        last = np.cumsum([len(s) for s in stretches])
        if not np.isin(last, common).all():
            return None
        n = np.stack([np.diff(np.searchsorted(x, last) + 1, prepend=0) for x in (ends_a, ends_b, common, ends)], axis=1)
        # the ids in order of groups, A before B, each with the sign behind it
        of = np.concatenate([2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1])
        order = np.argsort(of, kind="stable")
        of = of[order]
        sign = np.where(np.diff(of, append=-1) == 0, 0, 1 + of % 2)
        pieces = list(map(self.told.__getitem__, (sign * (len(self.told) // 3) + np.concatenate([a, b])[order]).tolist()))
        upto = np.cumsum(n[:, 0] + n[:, 1]).tolist()
        return n, ["".join(pieces[i:j]) for i, j in zip([0, *upto], upto, strict=False)], a[at_a] * words.size_b + b[at_b]

    def keep(self, stretches: list[str], found) -> None:
        n, told, codes = found
        k, upto = len(self.place), self.used + len(codes)
        self.n, self.codes = self.room(self.n, k + len(n)), self.room(self.codes, upto)
        self.n[k:k + len(n), :4] = n
        self.n[k:k + len(n), 4] = self.used + np.cumsum(n[:, 3]) - n[:, 3]
        self.codes[self.used:upto] = codes
        self.used = upto
        self.held += sum(map(len, stretches))
        self.groups += told
        self.place.update(zip(stretches, range(k, k + len(n)), strict=True))

    def learn(self, stretches: list[str]) -> None:
        """Stretches are encoded many at a time, one behind another; blanks alone would join the next one's."""
        alone, some = [s for s in stretches if s.isspace()], [s for s in stretches if not s.isspace()]
        for at in range(0, len(some), JOINT):
            part = some[at:at + JOINT]
            (a,), (b,) = self.words.encode(["".join(part)])
            found = self.align([s.encode() for s in part], a, b)
            if found is None:
                alone += part
            else:
                self.keep(part, found)
        for stretch, a, b in zip(alone, *self.words.encode(alone), strict=True):
            found = self.align([stretch.encode()], a, b)
            self.keep([stretch], found or (np.array([[0, 0, 0, -1]]), [""], np.zeros(0, np.int64)))

    def known(self, stretches: set[str]) -> None:
        """Learns what is new of ``stretches``; all of them are kept afterwards."""
        new = {s for s in stretches if s not in self.place}
        if self.place and (len(self.place) + len(new) > KEPT or self.held + sum(map(len, new)) > KEPT_BYTES):
            self.clear()
            new = stretches
        self.learn(list(new))

    def total(self, parts: Iterable[list[str]]):
        """n_a, n_b, n_groups, digest, codes of the links and how often each occurs, of a text in parts of its stretches;
        None where bytes differ."""
        totals, digest, codes, held = np.zeros(3, np.int64), hashlib.sha256(), [], ""
        for part in parts:
            self.known(set(part))
            places = list(map(self.place.__getitem__, part))
            n = self.n[places]
            if (n[:, 3] < 0).any():
                return None
            totals += n[:, :3].sum(axis=0)
            codes.append(np.unique(self.codes[ranges(n[:, 4], n[:, 3])], return_counts=True))
            digest.update(held.encode())
            held = "".join([self.groups[p] for p in places])
        digest.update(held[:-1].encode())
        codes = codes[0] if len(codes) == 1 else summed(*map(np.concatenate, zip(*codes, strict=True)))
        return (*totals.tolist(), digest.hexdigest(), *codes)

    def __call__(self, texts: list[str]) -> list:
        """``total`` of texts that begin with a blank."""
        if not self.words.parted:
            found = [self.align([t.encode()], a, b) for t, a, b in zip(texts, *self.words.encode(texts), strict=True)]
            return [f and (*f[0][0, :3].tolist(), hashlib.sha256(f[1][0][:-1].encode()).hexdigest(), *np.unique(f[2], return_counts=True)) for f in found]
        if sum(map(len, texts)) > AT_ONCE:
            return [self.total(self.parts(t)) for t in texts]
        split = [self.words.stretch.findall(t) for t in texts]
        self.known(set().union(*split))
        return [self.total([x]) for x in split]

    def parts(self, text: str) -> Iterator[list[str]]:
        """Stretches of a long text, some at a time."""
        found = self.words.stretch.finditer(text)
        while part := [m[0] for m in islice(found, PART)]:
            yield part


_ALIGNED: dict[tuple, Aligned] = {}


def aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """texts: key, text, times. Gives key, times, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct link codes
    with how often they occur in the text; texts without tokens are left out."""
    def make():
        if (path_a, path_b) not in _ALIGNED:  # a worker runs many tasks
            _ALIGNED[path_a, path_b] = Aligned(Words(path_a, path_b))
        align = _ALIGNED[path_a, path_b]

        def work(part, texts):
            rows = []
            for i, found in enumerate(align([" " + t.decode() for t in texts])):
                if found is not None:
                    codes, occurs = found[4:]
                    rows.append((i, *found[:4], int(occurs.sum()), codes.astype("<i8").tobytes(), occurs.astype("<u4").tobytes()))
            if not rows:
                return None
            at, n_a, n_b, groups, digest, links, codes, occurs = zip(*rows, strict=True)
            few = part.take(pa.array(at))
            return {"key": few.column("key"), "times": few.column("times"), "n_a": pa.array(n_a, pa.int64()), "n_b": pa.array(n_b, pa.int64()),
                    "n_groups": pa.array(groups, pa.int64()), "n_links": pa.array(links, pa.int64()), "groups_sha256": digest,
                    "codes": pa.array(codes, pa.binary()), "occurs": pa.array(occurs, pa.binary())}
        return work

    return per_text(texts, "key binary, times bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes binary, occurs binary", make)


def links_of(part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, occurrences) of the rows of a batch."""
    codes = raw(part.column("codes"))
    row = np.repeat(np.arange(len(codes)), [len(c) // 8 for c in codes])
    return row, np.frombuffer(b"".join(codes), "<i8"), np.frombuffer(b"".join(raw(part.column("occurs"))), "<u4").astype(np.int64)


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the exact sums of ``n``."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def pair_sums(aligned: DataFrame, size_b: int) -> DataFrame:
    """code, n (links of the pair over all rows) and whether no pair of its B id has more."""
    def run(batches):
        held, size = [], 0

        def flush():
            return pa.RecordBatch.from_pydict(dict(zip(("code", "n"), map(pa.array, held[0]), strict=True)))

        for part in slices(batches, column="codes"):
            row, codes, occurs = links_of(part)
            held.append((codes, occurs * part.column("times").to_numpy()[row]))
            size += len(codes)
            if size > SUMMED:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > SUMMED // 2:
                    yield flush()
                    held, size = [], 0
        if size:
            held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
            yield flush()

    sums = cut_lineage(aligned.select("times", "codes", "occurs").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")))
    b = F.col("code") % size_b
    most = sums.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # one row per B id
    return sums.join(most, b == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def text_measures(aligned: DataFrame, sums: DataFrame) -> DataFrame:
    """key, n_best, count_sum of each text."""
    common = sums.orderBy(F.desc("n"), "code").limit(COMMON).toPandas().sort_values("code")  # at most COMMON rows
    sent = aligned.sparkSession.sparkContext.broadcast(tuple(common[c].to_numpy() for c in ("code", "n", "best")))

    def run(batches):
        known, sums, best = sent.value
        for part in slices(batches, column="codes"):
            row, codes, occurs = links_of(part)
            at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            here = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            total, links = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            np.add.at(total, row[here], occurs[here] * sums[at[here]])
            np.add.at(links, row[here], occurs[here] * best[at[here]])
            rest, ends = ~here, np.searchsorted(row[~here], np.arange(part.num_rows + 1))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_pydict({"key": part.column("key"), "n_best": pa.array(links), "count_sum": pa.array(total),
                                              "codes": pa.ListArray.from_arrays(offsets, pa.array(codes[rest])), "occurs": pa.ListArray.from_arrays(offsets, pa.array(occurs[rest]))})

    first = aligned.select("key", "codes", "occurs").mapInArrow(run, "key binary, n_best bigint, count_sum bigint, codes array<bigint>, occurs array<bigint>")
    first = cut_lineage(first)
    rest = first.select("key", F.explode(F.arrays_zip("codes", "occurs")).alias("link")).select("key", F.col("link.codes").alias("code"), F.col("link.occurs").alias("occurs"))
    added = rest.join(sums, "code").groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("occurs")).otherwise(0)).alias("more_best"), F.sum(F.col("occurs") * F.col("n")).alias("more_sum"))
    return first.join(added, "key", "left").select("key", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                                                   (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def pair_codes(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def alignment(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """Measures of every row of ``docs``, and the table of pairs: a, b, n, best."""
    rows = id_and_text(docs)
    key = F.unhex(F.sha2(F.col("text"), 256))
    texts = rows.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("times")).withColumn("key", key)
    aligned = cut_lineage(aligned_texts(texts, path_a, path_b))
    size_b = pair_codes(path_b)
    sums = cut_lineage(pair_sums(aligned, size_b))
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    measures = cut_lineage(aligned.select("key", "times", *names).join(text_measures(aligned, sums), "key"))
    every = aligned.agg(F.sum("times")).first()[0] or 0
    hot = F.col("times") * HOT_SHARE > every
    keys = rows.select("doc_id", F.coalesce(key, F.lit(b"")).alias("key"))
    fields = [*names[:4], "n_best", "count_sum", names[4]]
    sent = F.broadcast(measures.where(hot).select(F.col("key").alias("hot_key"), F.struct(*fields).alias("hot")))  # fewer than HOT_SHARE rows
    first = keys.join(sent, F.col("key") == F.col("hot_key"), "left")
    # rows without tokens never meet in the join: null keys are not moved to one place by a left join on a spread key
    spread = F.when(F.col("hot").isNull() & (F.octet_length("key") > 0), F.col("key"))
    rest = measures.where(~hot).select(F.col("key").alias("of"), F.struct(*fields).alias("own"))
    found = first.withColumn("sought", spread)
    out = found.where("sought IS NOT NULL").join(rest, F.col("sought") == F.col("of"), "left").select("doc_id", F.col("own").alias("m"))
    out = out.unionByName(found.where("sought IS NULL").select("doc_id", F.col("hot").alias("m")))
    zero = {n: F.coalesce(F.col(f"m.{n}"), F.lit(0).cast("bigint")).alias(n) for n in fields}
    zero["groups_sha256"] = F.coalesce(F.col("m.groups_sha256"), F.lit("")).alias("groups_sha256")
    pairs = sums.select(F.floor(F.col("code") / size_b).cast("bigint").alias("a"), (F.col("code") % size_b).alias("b"), "n", "best")
    return out.select("doc_id", *[zero[n] for n in fields]), pairs
