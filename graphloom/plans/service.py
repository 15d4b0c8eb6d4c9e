"""Stored builds as a catalog: index a repository, list repositories, branches and builds, resolve URLs, search symbols.

Every answer is a DataFrame over the tables that ``builds.write``
sorted by key, so a lookup skips row groups; nothing is kept in the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import decode_branch, encode_branch
from graphloom.functions.urls import parse
from graphloom.operators import nodejson, search
from graphloom.plans import builds, interchange

#: Name of a language -> ``(spark, root) -> (nodes, items)``: what ``Service.index`` can read.
Language = Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]
LANGUAGES: dict[str, Language] = {}


def language(name: str) -> Callable[[Language], Language]:
    """Register a reader of a language's nodes and search items (``schema.NODE``, ``schema.INDEX_ITEM``)."""

    def keep(read: Language) -> Language:
        LANGUAGES[name] = read
        return read

    return keep


@language("interchange")
def interchange_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    from graphloom.sources import uim

    return uim.read(spark, f"{root}/nodes.uim"), uim.read(spark, f"{root}/search.uim", "items")


def repo_order(repos: DataFrame) -> DataFrame:
    """Public repositories first, then by name."""
    return repos.orderBy(F.desc("public"), "name")


def select_repos(repos: DataFrame, builds: DataFrame | None = None, owner: str | None = None) -> DataFrame:
    """Repositories of an owner, or those that have builds, or both."""
    kept = repos if owner is None else repos.where(F.col("owner") == owner)
    return kept if builds is None else kept.join(builds.select(F.col("repo_id").alias("id")).distinct(), "id", "left_semi")


class Service:
    """Builds stored below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    @staticmethod
    def _checked(*keys: str) -> None:
        for key in keys:
            if re.search("[./]", key):
                raise ValueError(f"bad argument {key!r}")

    def _table(self, repo: str, build: str, name: str) -> DataFrame:
        self._checked(repo, build)
        return self.spark.read.parquet(f"{self.folder}/{repo}/{build}/{name}")

    def index(self, repo: str, branch: str, build: str, root: str, lang: str = "interchange", prefix: str = "/") -> DataFrame:
        """Index the repository at ``root`` and store the build; the catalog of builds.

        The newest build of the branch, or else of the repository, is continued:
        ids stay, and unchanged nodes and reference sets are not written again.
        """
        self._checked(repo, build)
        nodes, items = LANGUAGES[lang](self.spark, root)
        before = builds.latest(self.spark, self.folder, repo, branch) or builds.latest(self.spark, self.folder, repo)
        found = interchange.index(nodes, items, prefix, builds.ids(self.spark, self.folder, repo, before))
        return builds.write(found, self.folder, repo, branch, build, before)

    def all_builds(self) -> DataFrame:
        return builds.catalog(self.spark, self.folder)

    def repos(self) -> DataFrame:
        """``id, public, owner, shared_with_users, name``: a local store has no owners."""
        none = F.lit(None).cast("string")
        ids = self.all_builds().select(F.col("repo_id").alias("id")).distinct()
        return repo_order(ids.select("id", F.lit(True).alias("public"), none.alias("owner"), F.array().cast("array<string>").alias("shared_with_users"), F.col("id").alias("name")))

    def branches(self, repo: str) -> DataFrame:
        """``id``: names of branches, slashes encoded."""
        return self.all_builds().where(F.col("repo_id") == repo).select(encode_branch(F.col("branch")).alias("id")).distinct().orderBy("id")

    def builds(self, repo: str, branch: str) -> DataFrame:
        """Builds of a branch (as ``branches`` gives it, or plain), newest first."""
        return self.all_builds().where((F.col("repo_id") == repo) & ((F.col("branch") == branch) | (F.col("branch") == decode_branch(F.lit(branch))))).orderBy(F.desc("ended"), F.desc("build_id"))

    def build(self, repo: str, branch: str, build: str) -> DataFrame:
        """One build with the places of its tables."""
        row = self.builds(repo, branch).where(F.col("build_id") == build)
        return row.withColumns({"search_index": F.lit(f"{self.folder}/{repo}/{build}/items"), "code_root": F.lit("path:"), "status": F.when(F.col("ready"), "Ready").otherwise("Failed")})

    def resolve(self, repo: str, build: str, urls: DataFrame) -> DataFrame:
        """``url, status, node_id, content``: nodes and reference sets as JSON.

        Nodes go by id, symbol or path (the empty one is the root), reference
        sets by node and place. Status is ok, not found, bad url, or unsupported
        for slices of blobs, which this store does not have.
        """
        asked = urls.select("url").distinct().withColumn("h", parse(F.col("url")))
        kind = F.col("h.kind")
        by_path = asked.where(kind.isin("path", "token")).select("url", F.col("h.path").alias("path")).join(self._table(repo, build, "paths").select("path", "node_id"), "path", "left").drop("path")
        wanted = asked.where(kind.isin("id", "direct")).select("url", F.col("h.node_id").alias("node_id")).unionByName(by_path)
        by_symbol = asked.where(kind == "sym").select("url", F.col("h.sym_id").alias("sym_id")).join(self._table(repo, build, "symmap").select("sym_id", "node_id"), "sym_id", "left").drop("sym_id")
        wanted = wanted.unionByName(by_symbol)
        # Every URL is in one branch to its end, so that no content is moved again to meet it.
        named = wanted.where("node_id is not null")
        held = builds.lookup(self.spark, self.folder, repo, build, named).withColumn("_found", F.col("id").isNotNull())
        there = F.col("_found")
        found = nodejson.encode(held, ("url", "node_id", "_found")).select("url", F.when(there, F.lit("ok")).otherwise("not found").alias("status"), F.when(there, F.col("node_id")).alias("node_id"), F.when(there, F.col("json")).alias("content"))
        refs = builds.references(self.spark, self.folder, repo, build).drop("written", "sha256").withColumn("_found", F.lit(True))
        sets = asked.where(kind == "refs").select("url", F.col("h.node_id").alias("node_id"), F.col("h.offset").alias("offset")).join(refs, ["node_id", "offset"], "left")
        of_set = F.to_json(F.struct("node_id", "offset", "refs"))
        found = found.unionByName(sets.select("url", F.when(there, F.lit("ok")).otherwise("not found").alias("status"), F.when(there, F.col("node_id")).alias("node_id"), F.when(there, of_set).alias("content")))
        none = {"node_id": F.lit(None).cast("long"), "content": F.lit(None).cast("string")}
        status = F.when(kind == "bad", "bad url").when(kind == "slice", "unsupported").otherwise("not found")
        rest = asked.where(~F.coalesce(kind.isin("id", "direct", "path", "token", "sym", "refs"), F.lit(False))).select("url", status.alias("status"))
        lost = wanted.where("node_id is null").select("url", F.lit("not found").alias("status"))
        return found.unionByName(rest.unionByName(lost).withColumns(none)).select("url", "status", "node_id", "content")

    def search(self, repo: str, build: str, query: str, limit: int = 10) -> DataFrame:
        """The best symbols and paths for a query."""
        items = search.index_table(self._table(repo, build, "items"))
        return search.fuzzy(items.withColumn("node_id", F.col("href.node_id")), query, limit, ordinal="node_id")
