"""The domain tables as views over the driver's test tables.

customer -> repositories, nation -> users, orders -> commits, pull requests and
payloads, events -> analyses, jobs and timed activity, lineitem -> file lists,
documents -> diffs.  `checks/prelude.py` states the same mapping in SQL.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS_AS_OF = date(2001, 8, 1)
MONTH_AS_OF = date(2001, 7, 20)
EVENTS_AS_OF = date(2024, 1, 30)
ORDER_MONTHS = (date(1995, 1, 1), date(2002, 1, 1))


class TestTables:
    __test__ = False

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._schemas: dict[str, T.StructType] = {}

    def schema(self, name: str) -> T.StructType:
        """The stored columns, with plain timestamps read as instants.

        Casting the column instead would keep time filters from the scan.
        """
        if name not in self._schemas:
            fields = self.spark.read.parquet(f"{self.dir}/{name}.parquet").schema
            self._schemas[name] = T.StructType(
                [T.StructField(f.name, T.TimestampType()) if f.dataType == T.TimestampNTZType() else f for f in fields]
            )
        return self._schemas[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schema(name)).parquet(f"{self.dir}/{name}.parquet")

    # --- dimensions ---------------------------------------------------------

    def users(self) -> DataFrame:
        n = F.col("n_nationkey")
        profile = (
            F.when(n % 3 == 0, F.lit("{}"))
            .when(n % 3 == 1, F.concat(F.lit('{"sync_interval_hours":'), (n % 24 + 1).cast("string"), F.lit("}")))
            .otherwise(F.lit('{"timezone":"UTC","gemini_analysis_enabled":false}'))
        )
        return self.read("nation").select(
            n.cast("long").alias("user_id"),
            n.cast("long").alias("github_user_id"),
            F.col("n_name").alias("github_login"),
            F.col("n_name").alias("display_name"),
            (n % 5 != 0).alias("has_token"),
            profile.alias("profile_data"),
        )

    def repositories(self) -> DataFrame:
        k = F.col("c_custkey")
        language = (
            F.when(F.col("c_mktsegment") == "AUTOMOBILE", "Python")
            .when(F.col("c_mktsegment") == "BUILDING", "TypeScript")
            .when(F.col("c_mktsegment") == "FURNITURE", "Go")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "COBOL")
        )
        day = F.lit("2001-01-01 00:00:00").cast("timestamp")
        synced = F.date_add(F.lit(date(2001, 1, 1)), (k % 200).cast("int")).cast("timestamp")
        return self.read("customer").select(
            k.alias("repo_id"),
            F.col("c_nationkey").cast("long").alias("user_id"),
            (k + 1_000_000_000).alias("github_repo_id"),
            F.concat(F.lower("c_mktsegment"), F.lit("/"), F.col("c_name")).alias("full_name"),
            F.lit(None).cast("string").alias("description"),
            language.alias("primary_language"),
            (k % 4 == 0).alias("is_private"),
            (F.col("c_acctbal") > 0).alias("is_active"),
            _metadata(k).alias("repo_metadata"),
            F.when(k % 10 != 0, synced).alias("last_synced_at"),
            day.alias("created_at"),
            F.date_add(F.lit(date(2001, 1, 1)), (k * 37 % 200).cast("int")).cast("timestamp").alias("updated_at"),
        )

    # --- facts over orders ----------------------------------------------------

    def orders(self) -> DataFrame:
        return self.read("orders").withColumn("at", F.col("o_orderdate"))

    def commits(self, with_files: bool = False, *extra: str) -> DataFrame:
        additions = F.floor("o_totalprice")
        commits = self.orders().select(
            *extra,
            F.col("o_orderkey").alias("commit_id"),
            F.col("o_custkey").alias("repo_id"),
            F.md5(F.col("o_orderkey").cast("string")).alias("github_commit_sha"),
            F.col("o_orderpriority").alias("message"),
            F.col("at").alias("committed_at"),
            additions.alias("additions"),
            (additions % 97).alias("deletions"),
        )
        if not with_files:
            return commits.withColumn("changed_files", F.lit(0))
        files = self.read("lineitem").groupBy(F.col("l_orderkey").alias("commit_id")).agg(
            F.count(F.lit(1)).alias("changed_files")
        )
        return commits.join(files, "commit_id", "left").withColumn(
            "changed_files", F.coalesce("changed_files", F.lit(0))
        )

    def pull_requests(self) -> DataFrame:
        additions = F.floor("o_totalprice")
        merged = F.when(
            F.col("o_orderstatus") == "F",
            F.date_add(F.to_date("at"), (F.col("o_orderkey") % 10).cast("int")).cast("timestamp"),
        )
        return self.orders().select(
            F.col("o_orderkey").alias("pr_id"),
            F.col("o_custkey").alias("repo_id"),
            (F.col("o_orderkey") + 500_000_000).alias("github_pr_id"),
            (F.col("o_orderkey") % 1000 + 1).cast("int").alias("github_pr_number"),
            F.col("o_orderpriority").alias("title"),
            F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"),
            additions.alias("additions"),
            (additions % 97).alias("deletions"),
            F.lit(1).alias("changed_files"),
            F.col("at").alias("pr_created_at"),
            merged.alias("pr_closed_at"),
            merged.alias("merged_at"),
        )

    def commit_payloads(self) -> DataFrame:
        """Landed commit records as JSON text; one in fifty without any date."""
        k = F.col("o_orderkey")
        stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        number = F.when(k % 100 == 99, 55).otherwise(k % 7).cast("int")
        files = F.transform(
            F.when(number > 0, F.sequence(F.lit(1), number)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(
                F.concat(F.lit("src/f"), i.cast("string")).alias("filename"),
                F.lit("modified").alias("status"),
                i.alias("additions"),
                F.when(i % 4 != 0, F.repeat(F.lit("ab"), (i % 4) * 100)).alias("patch"),
            ),
        )
        payload = F.struct(
            F.md5(k.cast("string")).alias("sha"),
            F.struct(
                F.when(k % 200 == 5, F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(400)))
                .otherwise(F.col("o_orderpriority"))
                .alias("message"),
                F.struct(F.when(k % 50 == 0, "").when(k % 50 != 1, stamp).alias("date")).alias("committer"),
                F.struct(F.when(k % 50 != 1, stamp).alias("date")).alias("author"),
            ).alias("commit"),
            F.struct(
                F.floor("o_totalprice").alias("additions"),
                F.when(k % 3 != 0, F.floor("o_totalprice") % 97).alias("deletions"),
            ).alias("stats"),
            files.alias("files"),
        )
        return self.orders().select(F.col("o_custkey").alias("repo_id"), k.alias("seq"), F.to_json(payload).alias("payload"))

    def pull_request_payloads(self) -> DataFrame:
        k = F.col("o_orderkey")
        stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        payload = F.struct(
            (k + 500_000_000).alias("id"),
            (k % 40).alias("number"),
            F.col("o_orderpriority").alias("title"),
            F.when(F.col("o_orderstatus") == "F", "closed").when(F.col("o_orderstatus") == "O", "open").alias("state"),
            F.floor("o_totalprice").alias("additions"),
            F.when(k % 60 != 7, stamp).alias("created_at"),
            F.when(F.col("o_orderstatus") == "F", stamp).otherwise("").alias("merged_at"),
            F.array(
                F.struct(F.col("o_orderstatus").alias("name")), F.struct(F.col("o_orderpriority").alias("name"))
            ).alias("labels"),
            F.struct(F.concat(F.lit("u"), (k % 25).cast("string")).alias("login")).alias("user"),
            F.struct(F.lit("topic").alias("ref")).alias("head"),
            F.struct(F.lit("main").alias("ref")).alias("base"),
        )
        return self.orders().select(F.col("o_custkey").alias("repo_id"), k.alias("seq"), F.to_json(payload).alias("payload"))

    def repository_payloads(self) -> DataFrame:
        """Listings: every repository under its own user, every third also under the next."""
        k = F.col("c_custkey")
        payload = F.struct(
            (F.lit(1_000_000_000) + k * 2).alias("id"),
            F.concat(F.lower("c_mktsegment"), F.lit("/"), F.col("c_name")).alias("full_name"),
            F.col("c_mktsegment").alias("language"),
            F.when(k % 3 != 0, k % 4 == 0).alias("private"),
            F.when(k % 2 == 0, k % 6 == 0).alias("fork"),
            F.when(k % 5 != 0, k).alias("stargazers_count"),
        )
        users = F.when(
            k % 3 == 0, F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 1) % 25)
        ).otherwise(F.array("c_nationkey"))
        return self.read("customer").select(
            F.explode(users.cast("array<long>")).alias("user_id"), k.alias("seq"), F.to_json(payload).alias("payload")
        )

    def language_payloads(self) -> DataFrame:
        k = F.col("c_custkey")
        sizes = F.to_json(
            F.create_map(
                F.lit("Python"), k * 31 % 97, F.lit("Go"), k * 17 % 89, F.lit("C"), k * 31 % 97, F.lit("Rust"), k * 7 % 120
            )
        )
        return self.read("customer").select(k.alias("repo_id"), k.alias("seq"), sizes.alias("payload"))

    def repo_files(self) -> DataFrame:
        """File listings: about twenty paths per repository."""
        part, line = F.col("l_partkey"), F.col("l_linenumber")
        names = F.array(*[F.lit(n) for n in ("go.mod", "Dockerfile", "pom.xml", "README.md", "main.c", "notes.txt", "a.py")])
        name = F.get(names, (part % 7).cast("int"))
        directory = F.concat(F.lit("d"), (part % 23).cast("string"))
        path = (
            F.when((part % 19 == 0) & (line % 2 == 0), name)
            .when(part % 5 == 0, F.concat(directory, F.lit("/sub/"), name))
            .otherwise(F.concat(directory, F.lit("/"), name))
        )
        return self.read("lineitem").select(
            F.floor(F.col("l_orderkey") / 5).alias("repo_id"), path.alias("path"), (part * 8 + line).alias("ord")
        )

    # --- facts over events ------------------------------------------------------

    def events(self) -> DataFrame:
        # props is always {"k": n}; stripping is much cheaper than parsing JSON
        k = F.translate("props", '{}":k ', "").cast("long")
        return self.read("events").withColumn("at", F.col("ts")).withColumn("k", k)

    def event_commits(self) -> DataFrame:
        return self.events().filter(F.col("event_type").isin("view", "click")).select(*_event_commit())

    def event_pull_requests(self) -> DataFrame:
        return self.events().filter(F.col("event_type") == "purchase").select(
            F.col("event_id").alias("pr_id"),
            F.col("user_id").alias("repo_id"),
            F.concat(F.lit("pr "), F.col("event_id").cast("string")).alias("title"),
            F.when(F.col("k") % 2 == 0, "open").otherwise("closed").alias("state"),
            F.floor("value").alias("additions"),
            F.col("k").alias("deletions"),
            F.col("at").alias("pr_created_at"),
            F.when(F.col("k") % 2 == 1, F.date_add(F.to_date("at"), (F.col("k") % 3).cast("int")).cast("timestamp")).alias(
                "merged_at"
            ),
        )

    def analyses(self) -> DataFrame:
        """Every event as an analysis; some are generated weekly or monthly summaries."""
        k, e = F.col("k"), F.col("event_id")
        kind = F.when(e % 30 == 0, "monthly_summary").when(e % 10 == 0, "weekly_summary").otherwise("commit")
        ident = e.cast("string")
        weekly = F.to_json(
            F.struct(
                F.lit("weekly_summary").alias("type"),
                F.date_format(F.trunc(F.date_sub(F.to_date("at"), 7), "week"), "yyyy-MM-dd").alias("week_start"),
                F.when(k % 4 != 0, F.concat(F.lit("h"), ident)).alias("highlight"),
                F.array(F.concat(F.lit("a"), ident)).alias("key_achievements"),
                F.array(F.concat(F.lit("t"), (k % 7).cast("string"))).alias("technologies_used"),
                k.alias("commits_count"),
                (k % 7).alias("prs_count"),
            )
        )
        monthly = F.to_json(
            F.struct(
                F.lit("monthly_summary").alias("type"),
                F.year("at").alias("year"),
                F.month("at").alias("month"),
                F.concat(F.lit("n"), ident).alias("narrative"),
                F.array(F.lit("g1"), F.lit("g2")).alias("growth_areas"),
                F.struct(k.alias("total_commits")).alias("month_stats"),
            )
        )
        tags = F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(
            F.array(F.concat(F.lit("t"), (k % 7).cast("string")), F.concat(F.lit("t"), (k % 5).cast("string")))
        )
        events = self.events()
        tenants = self.read("customer").select(
            F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("tenant")
        )
        # only generated summaries need their tenant, so only they are joined
        parts = [
            events.filter(kind == "commit").withColumn("tenant", F.lit(None).cast("long")),
            events.filter(kind != "commit").join(tenants, "user_id"),
        ]
        return parts[0].unionByName(parts[1]).select(
            e.alias("analysis_id"),
            kind.alias("source_type"),
            F.when(kind == "commit", e).otherwise(F.col("tenant")).alias("source_id"),
            F.col("user_id").alias("repo_id"),
            tags.alias("tech_tags"),
            F.col("event_type").alias("work_category"),
            F.concat("event_type", F.lit("-"), ident).alias("summary"),
            (F.col("value") / 100.0).alias("complexity_score"),
            F.when(kind == "weekly_summary", weekly).when(kind == "monthly_summary", monthly).alias("raw_response"),
            F.col("at").alias("analyzed_at"),
        )

    def sync_jobs(self) -> DataFrame:
        e = F.col("event_id")
        status = (
            F.when(F.col("event_type").isin("click", "view"), "completed")
            .when(F.col("event_type") == "purchase", "running")
            .when(F.col("event_type") == "signup", "pending")
            .otherwise("failed")
        )
        repo = F.when(e % 4 != 0, F.col("user_id"))
        return self.events().select(
            e.alias("job_id"),
            (F.col("k") % 25).alias("user_id"),
            repo.alias("repo_id"),
            F.when(repo.isNull(), "scheduled_sync").otherwise("manual_sync").alias("job_type"),
            status.alias("status"),
            F.col("k").alias("items_fetched"),
            F.col("at").alias("created_at"),
        )

    def repo_results(self) -> DataFrame:
        """Per-repository results of jobs of twenty repositories each."""
        e, k = F.col("event_id"), F.col("k")
        error = (
            F.when((F.col("event_type") == "error") & (k % 5 == 0), "rate_limit")
            .when(F.col("event_type") == "error", "api_error")
            .when((F.col("event_type") == "signup") & (k % 10 == 3), "unexpected_error")
        )
        return self.events().select(
            F.floor(e / 20).alias("job_id"),
            (e % 20).alias("ord"),
            F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("repo_full_name"),
            k.alias("items"),
            error.alias("error_type"),
            F.when(error.isNotNull(), F.concat(F.lit("m"), e.cast("string"))).alias("message"),
        )

    # --- diffs over documents ---------------------------------------------------

    def document_commits(self) -> DataFrame:
        """One commit per document, one changed file per line of it."""
        lines = F.split("text", "\n")
        files = F.transform(
            lines,
            lambda line, i: F.struct(
                F.when(i % 5 != 4, F.concat(F.lit("f"), i.cast("string"))).alias("filename"),
                F.when(i % 3 == 0, "added").alias("status"),
                line.alias("patch"),
            ),
        )
        return self.read("documents").select(
            F.col("doc_id").alias("commit_id"),
            F.col("doc_id").alias("repo_id"),
            F.col("source").alias("full_name"),
            F.col("lang").alias("message"),
            F.struct(files.alias("files"), F.when(F.col("source") == "src0", F.col("text")).alias("diff")).alias("raw_data"),
        )


def _event_commit() -> list[Column]:
    return [
        F.col("event_id").alias("commit_id"),
        F.col("user_id").alias("repo_id"),
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("message"),
        F.col("at").alias("committed_at"),
        F.floor("value").alias("additions"),
        F.col("k").alias("deletions"),
        F.lit(1).alias("changed_files"),
    ]


def _metadata(k: Column) -> Column:
    """Metadata documents: none, languages only, an analysis, an empty or odd one."""
    day = F.date_format(F.date_add(F.lit(date(2001, 5, 1)), (k % 90).cast("int")), "yyyy-MM-dd'T'00:00:00")
    stamp = F.concat(day, F.when(k % 12 == 2, F.lit("")).otherwise(F.lit("+00:00")))
    analysis = F.concat(
        F.lit('{"tech_analysis":{"domain":"'),
        F.when(k % 8 == 2, "devops").otherwise("quantum"),
        F.lit('","frameworks":["fw'),
        (k % 3).cast("string"),
        F.lit('","spark"],"analyzed_at":"'),
        stamp,
        F.lit('"},"languages":{"Go":'),
        k.cast("string"),
        F.lit("}}"),
    )
    return (
        F.when(k % 4 == 0, F.lit("{}"))
        .when(k % 4 == 1, F.concat(F.lit('{"languages":{"C":'), k.cast("string"), F.lit("}}")))
        .when(k % 4 == 2, analysis)
        .when(k % 8 == 3, F.lit('{"tech_analysis":{}}'))
        .otherwise(F.lit('{"tech_analysis":"n/a"}'))
    )
