"""Column expressions over sequences and alignments, all JVM-side.

Coordinates are 0-based and half-open, but for ``pos``, which is 1-based as in SAM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_OPS, REF_OPS, MATCH_OPS = ("M", "I", "S", "=", "X"), ("M", "D", "N", "=", "X"), ("M", "=", "X")


def revcomp(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGTNacgtn", "TGCANtgcan"))


def cigar_ops(cigar: Column) -> Column:
    """Array of ``(n, op)``."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.substring(p, 1, F.length(p) - 1).cast("int").alias("n"), F.right(p, F.lit(1)).alias("op")))


def _length(ops: Column, kinds) -> Column:
    return F.aggregate(F.filter(ops, lambda o: o["op"].isin(*kinds)), F.lit(0), lambda a, o: a + o["n"])


def ref_length(cigar: Column) -> Column:
    return _length(cigar_ops(cigar), REF_OPS)


def query_length(cigar: Column) -> Column:
    return _length(cigar_ops(cigar), QUERY_OPS)


def matched_length(cigar: Column) -> Column:
    return _length(cigar_ops(cigar), MATCH_OPS)


def clip_length(cigar: Column, end: str) -> Column:
    """Soft-clipped bases at the ``lead`` or ``trail``."""
    pattern = r"^(?:\d+H)?(\d+)S" if end == "lead" else r"(\d+)S(?:\d+H)?$"
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))


def max_insertion(cigar: Column) -> Column:
    sizes = F.transform(F.filter(cigar_ops(cigar), lambda o: o["op"] == "I"), lambda o: o["n"])
    return F.coalesce(F.array_max(sizes), F.lit(0))


def cigar_blocks(pos: Column, cigar: Column, project: bool = True) -> Column:
    """Array of ``(ref, query, n, src)``: runs of query bases with their place.

    ``src`` is 'A' for aligned bases and, with ``project``, 'p' for soft clips laid out
    beside them: a leading clip ends where the alignment begins, a trailing one begins
    where it ends.
    """
    start = F.struct((pos - 1).cast("int").alias("r"), F.lit(0).alias("q"), F.lit(False).alias("seen"), F.array().cast("array<struct<ref:int,query:int,n:int,src:string>>").alias("out"))

    def step(acc, o):
        aligned, clip = o["op"].isin(*MATCH_OPS), o["op"] == "S"
        at = F.when(clip & ~acc["seen"], acc["r"] - o["n"]).otherwise(acc["r"])
        block = F.struct(at.cast("int").alias("ref"), acc["q"].alias("query"), o["n"].alias("n"), F.when(aligned, "A").otherwise("p").alias("src"))
        wanted = aligned | clip if project else aligned
        return F.struct(
            (acc["r"] + F.when(o["op"].isin(*REF_OPS), o["n"]).otherwise(0)).cast("int").alias("r"),
            (acc["q"] + F.when(o["op"].isin(*QUERY_OPS), o["n"]).otherwise(0)).cast("int").alias("q"),
            (acc["seen"] | o["op"].isin(*REF_OPS)).alias("seen"),
            F.when(wanted, F.concat(acc["out"], F.array(block))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(cigar_ops(cigar), start, step, lambda acc: acc["out"])


def extract_window(pos: Column, cigar: Column, seq: Column, lo: int, hi: int, missing: str = ".") -> Column:
    """``(window, provenance, n_aligned)`` of reference positions [lo, hi).

    One piece of the sequence for each run that meets the window, and ``missing`` in
    the gaps between them.
    """
    return window_of(cigar_blocks(F.lit(1), cigar), pos, seq, lo, hi, missing)


def window_of(blocks: Column, pos: Column, seq: Column, lo: int, hi: int, missing: str = ".") -> Column:
    """``extract_window`` from ``cigar_blocks`` that were laid out from position 1."""
    shift = (pos - 1).cast("int")
    start = F.struct(F.lit(lo).alias("at"), F.lit("").alias("window"), F.lit("").alias("provenance"), F.lit(0).alias("n_aligned"))

    def step(acc, b):
        ref = b["ref"] + shift
        first, last = F.greatest(ref, acc["at"]), F.least(ref + b["n"], F.lit(hi))
        n, gap = last - first, F.repeat(F.lit(missing), first - acc["at"])
        grown = F.struct(
            last.alias("at"), F.concat(acc["window"], gap, F.substring(seq, b["query"] + first - ref + 1, n)).alias("window"),
            F.concat(acc["provenance"], gap, F.repeat(b["src"], n)).alias("provenance"), (acc["n_aligned"] + F.when(b["src"] == "A", n).otherwise(0)).alias("n_aligned"),
        )
        return F.when(n > 0, grown).otherwise(acc)

    def filled(acc):
        rest = F.repeat(F.lit(missing), F.lit(hi) - acc["at"])
        return F.struct(F.concat(acc["window"], rest).alias("window"), F.concat(acc["provenance"], rest).alias("provenance"), acc["n_aligned"].alias("n_aligned"))

    return F.aggregate(blocks, start, step, filled)


def aligned_in(pos: Column, cigar: Column, lo: Column, hi: Column) -> Column:
    """Aligned bases within [lo, hi)."""
    each = F.transform(cigar_blocks(pos, cigar, project=False), lambda b: F.greatest(F.lit(0), F.least(b["ref"] + b["n"], hi) - F.greatest(b["ref"], lo)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x.cast("int"))


def spans_window(pos: Column, cigar: Column, lo: Column, hi: Column) -> Column:
    """True if one aligned run covers [lo, hi)."""
    return F.exists(cigar_blocks(pos, cigar, project=False), lambda b: (b["ref"] <= lo) & (b["ref"] + b["n"] >= hi))


def letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda x: x != "")


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; the length difference counts too."""
    pairs = F.zip_with(letters(a), letters(b), lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    return F.aggregate(pairs, F.lit(0), lambda n, x: n + x)


def find_all(s: Column, probe: str) -> Column:
    """0-based offsets of every occurrence, overlaps included."""
    last = F.length(s) - len(probe)
    inside = F.filter(F.sequence(F.lit(0), last), lambda i: F.substring(s, i + 1, F.lit(len(probe))) == probe)
    return F.when(last >= 0, inside).otherwise(F.array().cast("array<int>"))


def best_offset(s: Column, motif: str, first: int, most: int) -> Column:
    """``(mismatches, offset)`` of the leftmost best place of ``motif`` that starts
    within the first ``first`` offsets, if at most ``most`` bases differ; else null."""
    last = F.least(F.length(s) - len(motif), F.lit(first - 1))
    scored = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(hamming(F.substring(s, i + 1, F.lit(len(motif))), F.lit(motif)).alias("mismatches"), i.alias("offset")))
    best = F.array_min(scored)
    return F.when((last >= 0) & (best["mismatches"] <= most), best)


def longest_run(s: Column, base: str) -> Column:
    """Length of the longest run of one letter."""
    runs = F.transform(F.regexp_extract_all(s, F.lit(f"({base}+)"), F.lit(1)), lambda r: F.length(r))
    return F.coalesce(F.array_max(runs), F.lit(0))


def entropy(s: Column) -> Column:
    """Shannon entropy of the letters, in bits."""
    def of(chars):
        shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
        return -F.aggregate(shares, F.lit(0.0), lambda a, p: a + p * F.log2(p))

    return F.transform(F.array(letters(s)), of)[0]


def trim_run(s: Column, base: str, least: int) -> Column:
    """``s`` up to its first run of at least ``least`` of one letter."""
    at = F.instr(s, base * least)
    return F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(s)


def between_flanks(s: Column, left: str, right: str, size: int) -> Column:
    """What lies between exact flanks on either strand, forward first; '' if absent."""
    pattern = f"{left}(.{{{size}}}){right}"
    forward, back = F.regexp_extract(s, pattern, 1), F.regexp_extract(revcomp(s), pattern, 1)
    return F.when(forward != "", forward).otherwise(back)


def registered_core(s: Column, markers: list[str], centre: Column, tolerance: int, skip: int, size: int) -> Column:
    """``(core, complete, marker, offset)`` found by a marker near ``centre``.

    The core begins ``skip`` letters after the marker.  Complete cores win over partial
    ones, then the earlier marker, then the leftmost offset; among partial ones the
    longest wins.  Null if no marker is near.
    """
    def candidate(marker, turn):
        def row(i):
            core = F.substring(s, i + 1 + len(marker) + skip, F.lit(size))
            short = F.length(core) < size
            return F.struct(short.alias("short"), F.when(short, -F.length(core)).otherwise(0).alias("less"), F.lit(turn).alias("marker"), i.alias("offset"), core.alias("core"))

        return row

    def starts(marker):
        return lambda i: F.substring(s, i + 1, F.lit(len(marker))) == marker

    found = []
    for turn, marker in enumerate(markers):
        low = F.greatest(F.lit(0), centre - tolerance)
        places = F.filter(F.sequence(low, F.greatest(low, centre + tolerance)), starts(marker))

        found.append(F.transform(places, candidate(marker, turn)))
    best = F.array_min(F.concat(*found))
    return F.when(best.isNotNull(), F.struct(best["core"].alias("core"), (~best["short"]).alias("complete"), best["marker"].alias("marker"), best["offset"].alias("offset")))


def tolerant_core(s: Column, five: str, three: str, size: int, least: int, most: int) -> Column:
    """The ``size`` letters after the first ``five``, if what follows them begins like
    ``three``: from its first or second letter on, at least ``least`` letters compared, at
    most ``most`` of them different.  Null otherwise, or if the core is cut short."""
    at = F.instr(s, five)
    core = F.substring(s, at + len(five), F.lit(size))
    after = F.substring(s, at + len(five) + size, F.lit(len(three)))

    def fits(shift: int) -> Column:
        wanted = three[shift:]
        n = F.least(F.length(after), F.lit(len(wanted)))
        wrong = F.aggregate(F.sequence(F.lit(1), F.lit(len(wanted))), F.lit(0), lambda a, k: a + F.when((k <= n) & (F.substring(after, k, F.lit(1)) != F.substring(F.lit(wanted), k, F.lit(1))), 1).otherwise(0))
        return (n >= least) & (wrong <= most)

    return F.when((at > 0) & (F.length(core) == size) & (fits(0) | fits(1)), core)


def one_off(s: Column, alphabet: str = "ACGT") -> Column:
    """``(turn, variant)``: the string and all its one-letter variants over the alphabet,
    in the order of position and letter."""
    def at(c, i):
        return F.transform(F.filter(F.array(*map(F.lit, alphabet)), lambda b: b != c), lambda b: F.concat(F.substring(s, F.lit(1), i), b, F.substring(s, i + 2, F.length(s))))

    return F.concat(F.array(s), F.flatten(F.transform(letters(s), at)))
