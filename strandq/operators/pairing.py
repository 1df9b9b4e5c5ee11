"""Variants of several sources at one place, paired where their alleles agree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules under which records with no allele in common pair: of the same kind, either of them with records of the reference
#: alone, or any.  Without a rule one common allele is needed; EXACT needs all alleles to be the same.
RULES = ("snps", "indels", "snp_ref", "indel_ref", "any")
EXACT = "exact"
_SURE = 9

Variant = tuple[str, tuple[str, ...]]


def kinds(ref: str, alts: tuple[str, ...]) -> frozenset[str]:
    """ref, snp (of several bases too), indel, other: what a record's alleles are."""
    out = set()
    for alt in alts:
        if alt not in (".", "*", "<*>") and alt.upper() != ref.upper():
            plain = not alt.upper().strip("ACGTN")
            out.add("other" if not plain else "snp" if len(alt) == len(ref) else "indel")
    return frozenset(out or {"ref"})


def _rank(a: str, b: str, rules: frozenset[str]) -> int:
    """How willingly two kinds pair: 3 of the same, 2 with the reference, 1 anything, 0 never."""
    pair = {a, b}
    for kind, alone, with_ref in (("snp", "snps", "snp_ref"), ("indel", "indels", "indel_ref")):
        if pair == {kind} and rules & {alone, "any"}:
            return 3
        if pair == {kind, "ref"} and rules & {with_ref, "any"}:
            return 2
    return int("any" in rules)


def _score(a: Variant, b: Variant, rules: frozenset[str]) -> int:
    """Of two records: _SURE if their alleles agree, else the rank of their kinds, the best of several."""
    x, y = kinds(*a), kinds(*b)
    change = lambda v: {(v[0].upper(), alt.upper()) for alt in v[1]}
    if EXACT in rules:
        return _SURE if x == y and len(a[1]) == len(b[1]) and change(a) == change(b) else 0
    if x & y and change(a) & change(b):
        return _SURE
    return max(_rank(p, q, rules) for p in x for q in y)


def paired_sets(records: list[tuple[int, str, tuple[str, ...], int]], rules: frozenset[str]) -> list[list[tuple[int, str, tuple[str, ...]]]]:
    """The records (source, ref, alts, number of such rows) of one place, in sets of at most one of each source.

    Sources with the same records are one group.  The set that most sources have takes the one that suits it best (the worst
    pair of records counts, then how many sources both have) and shares no group with it, again and again; then the next.
    """
    rows = sorted((s, (ref, alts), k) for s, ref, alts, n in records for k in range(n))
    own: dict[int, list] = {}
    for s, v, k in rows:
        own.setdefault(s, []).append((v, k))
    group = {s: tuple(v) for s, v in own.items()}
    holders: dict[tuple, list[int]] = {}
    for s, v, k in rows:
        holders.setdefault((v, k), []).append(s)
    sets = [([v], [(s, v[0]) for s in sources], {group[s] for s in sources}) for v, sources in holders.items()]
    out = []
    while sets:
        first = max(range(len(sets)), key=lambda i: (len(sets[i][1]), -i))
        best, at = (0, 0), -1
        for i, other in enumerate(sets):
            if i != first and not sets[first][2] & other[2]:
                each = [_score(a[0], b[0], rules) for a in sets[first][0] for b in other[0]]
                worst = min(each)
                # One pair that agrees settles it, if none before it is forbidden.
                sure = _SURE in each and 0 not in each[: each.index(_SURE)]
                score = (_SURE, 0) if sure else (worst, len(sets[first][1]) + len(other[1])) if worst else (0, 0)
                if score > best:
                    best, at = score, i
        if at < 0:
            out.append(sorted((s, *v) for s, v in sets.pop(first)[1]))
            continue
        low, high = sorted((first, at))
        sets[low] = tuple(x + y if isinstance(x, list) else x | y for x, y in zip(sets[low], sets.pop(high), strict=True))
    return out


def paired(sources: list[DataFrame], *rules: str) -> DataFrame:
    """chrom, pos, nth, sources, records of variants (chrom, pos, ref, alts as an array) of several sources: sets of records, one
    of each source at most, whose alleles overlap, or pair under the rules; nth numbers the sets of a place in the order
    in which they were found, sources are counted from 1, records hold source, ref and alts.

    Repeated records of a source are records of their own.  Alleles compare without case.  Rows with a null place or
    reference are left out; null alts are those of the reference alone.  Equal records are counted before they meet, so that a
    place holds its different records only.
    """
    if wrong := set(rules) - {*RULES, EXACT}:
        raise ValueError(f"no such rules: {sorted(wrong)}")
    every = None
    for i, s in enumerate(sources, 1):
        alts = F.when(F.size(F.coalesce("alts", F.array())) > 0, F.transform("alts", lambda x: F.coalesce(x, F.lit(".")))).otherwise(F.array(F.lit(".")))
        s = s.filter("chrom is not null and pos is not null and ref is not null").select("chrom", "pos", F.lit(i).alias("source"), "ref", alts.alias("alts"))
        every = s if every is None else every.unionByName(s)
    counted = every.groupBy("chrom", "pos", "source", "ref", "alts").agg(F.count("*").alias("n"))
    places = counted.groupBy("chrom", "pos").agg(F.collect_list(F.struct("source", "ref", "alts", "n")).alias("r"))
    chosen = frozenset(rules)

    @F.pandas_udf("array<array<struct<source:int,ref:string,alts:array<string>>>>")
    def run(columns: pd.Series) -> pd.Series:
        sets = lambda some: paired_sets([(int(x["source"]), x["ref"], tuple(x["alts"]), int(x["n"])) for x in some], chosen)
        return columns.map(lambda some: [[{"source": s, "ref": ref, "alts": list(alts)} for s, ref, alts in one] for one in sets(some)])

    found = places.select("chrom", "pos", run("r").alias("sets")).select("chrom", "pos", F.posexplode("sets").alias("nth", "records"))
    return found.select("chrom", "pos", "nth", F.array_sort(F.transform("records", lambda x: x["source"])).alias("sources"), "records")
