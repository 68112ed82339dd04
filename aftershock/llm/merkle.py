"""Merkle manifest of the documents: a tree for each language, and one over the languages.

Leaves are numbered within their language and dealt into superblocks of whole subtrees. Each superblock is reduced to one
node; the few nodes go on in the same way until a language has one. On the way back every node learns the siblings
on its path to the root, and at last leaves and these outer nodes are cogrouped by superblock, where the local
reduction, the proofs and the folding are done together. Texts are hashed where they are read and never move.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, staged
from .ranks import ranked

#: Nodes hashed into one, and levels in a superblock: 8 ** 4 leaves.
FANOUT = 8
LEVELS = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What stands left and right of the path on each level, one after the other.
_PATH = "path array<string>"


# --- hashing


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    """Hash of a row of documents with ``text`` as its text."""
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.sha2(F.concat(*map(_field, fields)), 256)


def document_leaves(documents: DataFrame, tampered: Column | None = None, tampered_text: Column | None = None) -> DataFrame:
    """One row per document: doc_id, lang, leaf, and ``changed``: the leaf it would have with ``tampered_text`` where
    ``tampered`` holds, else null."""
    changed = F.lit(None).cast("string")
    if tampered is not None:
        changed = F.when(tampered, leaf_hash(tampered_text))
    return documents.select("doc_id", "lang", leaf_hash(F.col("text")).alias("leaf"), changed.alias("changed"))


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def reduced(nodes: list[str], levels: int | None) -> list[list[str]]:
    """The nodes of each level, ``nodes`` first: ``levels`` above it, or as many as it takes to one node."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append([_hash("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """For each level, what stands left and what stands right of the path from node ``i``, within its run."""
    path = []
    for below in levels[:-1]:
        start = i - i % FANOUT
        path += "".join(below[start:i]), "".join(below[i + 1 : start + FANOUT])
        i //= FANOUT
    return path


def fold(node: str, path: Sequence[str]) -> str:
    """The root that a node and its path give."""
    for left, right in zip(path[::2], path[1::2]):
        node = _hash(left + node + right)
    return node


def _local(nodes: list[str], block: int) -> list[list[str]]:
    # a first superblock that is not alone is full and takes its levels anyway
    return reduced(nodes, LEVELS if block else None)


def _outer(rows: pd.DataFrame) -> list[str]:
    return list(rows["path"].iloc[0])


# --- up and down the tree


def _reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    group, block = key
    top = _local(rows.sort_values("rank")["node"].tolist(), block)[-1][0]
    return pd.DataFrame({"grp": [group], "rank": [block], "node": [top]})


def _descend(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rank")
    levels, above = _local(rows["node"].tolist(), key[1]), _outer(outer)
    paths = [siblings(levels, i) + above for i in range(len(rows))]
    return pd.DataFrame(
        {"grp": key[0], "rank": rows["rank"].array, "node": rows["node"].array, "path": paths, "top": outer["top"].iloc[0]}
    )


def _in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("rank") / FANOUT**LEVELS).cast("long"))


def _as_blocks(nodes: DataFrame):
    return nodes.withColumnRenamed("rank", "block").groupBy("grp", "block")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """``grp, rank, node`` reduced by superblocks until each group has one node; the tables from the bottom up."""
    out = [nodes]
    while (out[-1].agg(F.max("rank")).first()[0] or 0) > 0 or len(out) == 1:
        blocks = _in_blocks(out[-1]).groupBy("grp", "block")
        out.append(staged(blocks.applyInPandas(_reduce, "grp string, rank long, node string"), "nodes"))
    return out


def paths(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``grp, rank, node, path, top`` of the nodes of the lowest of ``tables``; ``tops`` has those of the groups' only nodes."""
    found = tops
    for nodes in reversed(tables[:-1]):
        below = _in_blocks(nodes).groupBy("grp", "block").cogroup(_as_blocks(found))
        found = staged(below.applyInPandas(_descend, f"grp string, rank long, node string, {_PATH}, top string"), "paths")
    return found


def _finish(keep_proofs: bool):
    def finish(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        levels, above = _local(rows["node"].tolist(), key[1]), _outer(outer)
        subroot, root = outer["subroot"].iloc[0], outer["top"].iloc[0]
        tail = "".join(above)
        proofs, sums, folded = [], [], []
        for i, (leaf, changed) in enumerate(zip(rows["node"], rows["changed"])):
            local = siblings(levels, i)
            sums.append(_hash("".join(local) + tail))
            folded.append(fold(fold(leaf if changed is None else changed, local), above))
            if keep_proofs:
                proofs.append(local + above)
        out = {
            "doc_id": rows["doc_id"].array,
            "leaf": rows["node"].array,
            "subroot": subroot,
            "root": root,
            "proof_sha256": sums,
            "folded_root": folded,
            "verified": [f == root for f in folded],
        }
        return pd.DataFrame(out | ({"proof": proofs} if keep_proofs else {}))

    return finish


def manifest(leaves: DataFrame, keep_proofs: bool = False) -> DataFrame:
    """Proofs of all leaves: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``leaves`` is what ``document_leaves`` gives. Leaves ascend by doc_id within their language, null first, rows that share
    an id by their hash; equal rows are leaves of their own. A null language is a group of its own, before the others. A
    lone leaf is its language's subroot, a lone subroot the root. ``folded_root`` is what the changed leaf, or else the leaf,
    gives with the siblings of the unchanged tree. Null fields, empty and long texts are part of the hash as they are. No
    rows give no rows. With ``keep_proofs`` the siblings themselves come as ``proof``, two texts for each level: those left and right of the path.
    """
    prepare(leaves.sparkSession)
    # the order of the keys is that of the languages, null first
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    rows = leaves.select(group.alias("grp"), "doc_id", F.col("leaf").alias("node"), "changed")
    rows = ranked(staged(rows, "leaves"), "grp", ["doc_id", "node"], "leaves")
    trees = climb(rows.select("grp", "rank", "node"))
    subroots = trees[-1].select(F.col("grp").alias("lang"), F.col("node"))
    over = ranked(subroots.withColumn("grp", F.lit("")), "grp", ["lang"], "subroots")
    top = climb(over.select("grp", "rank", "node"))
    none = F.array().cast("array<string>").alias("path")
    roots = top[-1].select("grp", "rank", "node", none, F.col("node").alias("top"))
    known = paths(top, roots).join(over.select("rank", "lang"), "rank").withColumn("subroot", F.col("node"))
    ends = known.select(F.col("lang").alias("grp"), F.lit(0).cast("long").alias("rank"), "node", "path", "top")
    outer = paths(trees[1:], ends).join(known.select(F.col("lang").alias("grp"), "subroot"), "grp")
    result = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if keep_proofs:
        result += ", " + _PATH.replace("path ", "proof ")
    found = _in_blocks(rows).groupBy("grp", "block").cogroup(_as_blocks(outer))
    return found.applyInPandas(_finish(keep_proofs), result)


def tampered_manifest(documents: DataFrame) -> DataFrame:
    """The manifest with every document whose id has a checksum divisible by three tampered with: its text in lower case.

    Only A-Z are changed, so a text without them, or a null text, stays as it is and verifies. A null id is not tampered with.
    """
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(document_leaves(documents, chosen, F.translate("text", _UPPER, _LOWER)))
