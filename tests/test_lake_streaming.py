"""K1-K10 lake writes, A28 stats, S9/S10 scans, F1 pruning and R1-R5 streaming."""

import pytest
from pyspark.sql import functions as F

from quire.plans.query import query_articles
from quire.sinks import lake
from quire.sources.files import list_files, read_parquets
from quire.streaming import incremental as INC
from tests.landing import land_from_driver

@pytest.fixture(autouse=True, scope="module")
def interpreted(spark):
    """Many large plans over a few rows: compiling them would take most of the time."""
    keys = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


KEY_COLS = {
    "editions": ["municipality", "edition_id", "publication_date", "total_articles", "edition_hash"],
    "articles": ["municipality", "article_id", "edition_id", "identifier", "depth", "content_hash"],
}


def _rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def _stable(spark, root):
    """The current tables without run columns, as sorted rows."""
    drop = ("batch_id", "processed_at")
    return {n: sorted(map(str, lake.read_current(spark, root, n).drop(*drop).collect()))
            for n in ("editions", "articles", "relationships")} | {
        "content": sorted(r.content_hash for r in lake.read_table(spark, root, "content").collect()),
        "rejects": sorted(map(str, INC.current_rejects(spark, root).collect()))}


def _landing(spark, sf_small, folder, n=60):
    """A small crawl: the first editions of the driver tables, all phases, two bad bodies."""
    land_from_driver(spark, sf_small, folder, n_batches=1)
    raw = spark.read.schema(INC.RAW_SCHEMA).option("recursiveFileLookup", "true").parquet(folder)
    rows = [r for r in raw.collect() if int(r.edition_id) % 1500 < n]
    rows.append(("rj_rio_de_janeiro", "metadata", "bad", None, "application/json", b"{nope", 10**9))
    rows.append(("rj_rio_de_janeiro", "structure", "late", "999999999", "text/html",
                 b'<ul id="tree"><li><a class="linkMateria" data-materia-id="1" identificador="x1">t</a></li></ul>', 10**9 + 1))
    return [tuple(r) for r in rows]


def test_result_does_not_depend_on_how_responses_are_grouped(spark, sf_small, tmp_dir):
    rows = _landing(spark, sf_small, f"{tmp_dir}/all")
    phase = {p: [r for r in rows if r[1] == p] for p in ("metadata", "structure", "content")}
    half = len(rows) // 2
    groupings = {
        "one file": [rows],
        "phases in reverse, one at a time": [phase["content"], phase["structure"], phase["metadata"]],
        "halves, ten files at once": [rows[half:], rows[:half]],
    }
    want = None
    for k, (name, groups) in enumerate(groupings.items()):
        land, root = f"{tmp_dir}/land{k}", f"{tmp_dir}/lake{k}"
        for i, g in enumerate(groups):
            spark.createDataFrame(g, INC.RAW_SCHEMA).coalesce(1).write.parquet(f"{land}/f{i}")
        stats = INC.run_incremental(spark, land, root, f"{tmp_dir}/ck{k}", "t", max_files_per_trigger=10 if k == 2 else 1,
                                    granularity="year")
        assert len(stats) == (1 if k == 2 else len(groups))
        got = _stable(spark, root)
        assert got["articles"] and got["content"] and any("invalid_json" in r for r in got["rejects"])
        assert any("orphan" in r for r in got["rejects"])
        want = want or got
        assert got == want, name
        # a drained stream adds nothing; a replayed batch changes nothing
        assert INC.run_incremental(spark, land, root, f"{tmp_dir}/ck{k}", "t", granularity="year") == []
    landed = spark.createDataFrame(rows, INC.RAW_SCHEMA)
    INC.ingest_batch(spark, landed, f"{tmp_dir}/lake0", "t_000000", "year")
    assert _stable(spark, f"{tmp_dir}/lake0") == want
    corpus, _ = INC.process_landed(spark, landed)  # the batch form agrees
    for k, cols in KEY_COLS.items():
        assert _rows(getattr(corpus, k), cols) == _rows(lake.read_current(spark, f"{tmp_dir}/lake0", k), cols)
    summary = lake.run_summary([{"editions": 2, "articles": 4, "seconds": 2.0}])
    assert summary["batches"] == 1 and summary["articles_per_s"] == 2


def test_recrawl_replaces_rows_and_reports_count_once(spark, sf_small, tmp_dir):
    from quire.plans import catalog
    rows = _landing(spark, sf_small, f"{tmp_dir}/all", n=40)
    once, twice = f"{tmp_dir}/once", f"{tmp_dir}/twice"
    landed = spark.createDataFrame(rows, INC.RAW_SCHEMA)
    INC.ingest_batch(spark, landed, once, "b1", "year")
    INC.ingest_batch(spark, landed, twice, "b1", "year")
    INC.ingest_batch(spark, landed, twice, "b2", "year")  # the same crawl again
    assert lake.read_table(spark, twice, "editions").count() == 2 * lake.read_table(spark, once, "editions").count()
    q = catalog.queries()
    for name in ("corpus_overview", "articles_per_year", "articles_by_type", "supplement_stats"):
        a, b = (sorted(map(str, q[name](spark, f"lake:{r}").collect())) for r in (once, twice))
        assert a == b, name


def test_empty_lake_reads_have_the_schema(spark, tmp_dir):
    for name in ("editions", "articles", "relationships", "content", "rejects"):
        df = lake.read_current(spark, f"{tmp_dir}/none", name)
        assert df.count() == 0 and "prefix" in df.columns or "batch_id" in df.columns
    assert query_articles(lake.read_current(spark, f"{tmp_dir}/none", "articles"), municipality="x", start_date="2020-01-01").count() == 0


def test_hot_partition_value_is_split_by_size(spark, tmp_dir):
    df = spark.range(60000).select(F.lit("m").alias("municipality"), F.lit(2020).alias("year"), F.lit("b").alias("batch_id"),
                                   F.sha2(F.col("id").cast("string"), 512).alias("x"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        lake._writer(df.repartition(8), ["municipality", "year", "batch_id"]).mode("overwrite").parquet(f"{tmp_dir}/hot")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert list_files(spark, f"{tmp_dir}/hot", ".parquet").count() > 1
    assert spark.read.parquet(f"{tmp_dir}/hot").count() == 60000


def test_store_that_cannot_be_read_raises_and_migrate_keeps_prefixes(spark, tmp_dir):
    import os
    from quire.operators import content as C
    body = next(("x%d" % i * 3000).encode() for i in range(999)
                if __import__("hashlib").sha256(("x%d" % i * 3000).encode()).hexdigest().startswith("0"))
    split = C.split_inline(C.dispatch(spark.createDataFrame([("a", "text/plain", body)],
                                                            "request_key string, content_type_header string, body binary")))
    lake.append_content(spark, split, f"{tmp_dir}/a")
    report = {r["table"]: r for r in lake.migrate(spark, f"{tmp_dir}/a", f"{tmp_dir}/b")}
    assert report["content"]["ok"] and report["content"]["rows"] == 1 and not report["editions"]["ok"]
    assert sorted(x for x in os.listdir(f"{tmp_dir}/b/content") if "=" in x) == sorted(
        x for x in os.listdir(f"{tmp_dir}/a/content") if "=" in x)
    own = __import__("hashlib").sha256(body).hexdigest()[:2]
    for root, prefix in (("bad", own), ("fine", "ff")):  # an unreadable file among the batch's prefixes, and beside them
        os.makedirs(f"{tmp_dir}/{root}/content/prefix={prefix}")
        with open(f"{tmp_dir}/{root}/content/prefix={prefix}/part-0.parquet", "wb") as f:
            f.write(b"not parquet")
    with pytest.raises(Exception):
        lake.append_content(spark, split, f"{tmp_dir}/bad")
    assert own != "ff" and lake.append_content(spark, split, f"{tmp_dir}/fine") == 1


def test_rewrite_same_batch_is_idempotent_and_pruning(spark, sf_small, tmp_dir):
    from quire.plans.ingest import build_corpus
    corpus = build_corpus(spark, sf_small)
    root = f"{tmp_dir}/lake"
    s1 = lake.write_corpus(spark, corpus, root, "b1", granularity="year")
    s2 = lake.write_corpus(spark, corpus, root, "b1", granularity="year")
    assert s1["editions"] == s2["editions"]
    eds = lake.read_table(spark, root, "editions")
    assert eds.count() == s1["editions"]
    assert lake.dry_run(corpus)["articles"] == s1["articles"]

    arts = lake.read_table(spark, root, "articles")
    q = query_articles(arts, municipality="rj_rio_de_janeiro", start_date="1996-01-01", end_date="1996-03-31")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan
    brute = arts.where((F.col("municipality") == "rj_rio_de_janeiro")
                       & F.col("publication_date").between("1996-01-01", "1996-03-31"))
    assert q.count() == brute.count()
    assert query_articles(arts).count() == arts.count()
    assert query_articles(arts, limit=5, order_by=["article_id"]).count() == 5

    lineage = read_parquets(spark, f"{root}/relationships")
    assert lineage.select("__source_file__").distinct().count() >= 1
    assert list_files(spark, f"{tmp_dir}/missing").count() == 0


def test_content_append_skips_known_hashes(spark, tmp_dir):
    from quire.operators import content as C
    df = spark.createDataFrame([("a", "text/plain", ("x" * 3000).encode())],
                               "request_key string, content_type_header string, body binary")
    split = C.split_inline(C.dispatch(df))
    assert lake.append_content(spark, split, tmp_dir) == 1
    assert lake.append_content(spark, split, tmp_dir) == 0
    assert spark.read.parquet(f"{tmp_dir}/content").count() == 1


def _two_portals():
    """Two portals use the same edition id and identifier; each lands its own body, and one
    lands another body later."""
    tree = b'<ul id="tree"><li><a class="linkMateria" data-materia-id="%s" identificador="77">t</a></li></ul>'
    rows = []
    for k, portal in enumerate(("ms_corumba", "ro_jaru")):
        edition = b'{"erro":false,"data":"2024-03-0%d","itens":[{"id":"5","suplemento":0,"numero":"1","tipo_edicao_id":1,"tipo_edicao_nome":"x"}]}' % (k + 1)
        rows += [(portal, "metadata", "2024", None, "application/json", edition, 10 * k),
                 (portal, "structure", "5", "5", "text/html", tree % b"1", 10 * k + 1),
                 (portal, "content", "77", "5", "text/plain", f"body of {portal}".encode(), 10 * k + 2)]
    return rows


def _bodies(df):
    return {(r.municipality, r.edition_id, r.identifier): r.inline_text for r in df.collect()}


def test_each_portal_keeps_its_own_body(spark, tmp_dir):
    rows = _two_portals()
    want = {("ms_corumba", "5", "77"): "body of ms_corumba", ("ro_jaru", "5", "77"): "body of ro_jaru"}
    frame = lambda r: spark.createDataFrame(r, INC.RAW_SCHEMA)
    corpus, split = INC.process_landed(spark, frame(rows))
    assert _bodies(corpus.articles) == want and corpus.totals.first().n_articles == 2
    for i, g in enumerate((rows[:3], rows[3:], [(rows[2][:5] + (b"second body", 99))])):
        frame(g).coalesce(1).write.parquet(f"{tmp_dir}/land/f{i}")
    INC.run_incremental(spark, f"{tmp_dir}/land", f"{tmp_dir}/lake", f"{tmp_dir}/ck", "t")
    got = _bodies(lake.read_current(spark, f"{tmp_dir}/lake", "articles"))
    assert got == want | {("ms_corumba", "5", "77"): "second body"}
    # content that only the other portal has landed is missing
    INC.ingest_batch(spark, frame([rows[0], rows[1], rows[5]]), f"{tmp_dir}/other", "b1")
    rejects = INC.current_rejects(spark, f"{tmp_dir}/other").collect()
    assert lake.read_current(spark, f"{tmp_dir}/other", "articles").count() == 0
    assert [(r.municipality, r.reason) for r in rejects] == [("ms_corumba", "missing_content")]


class Stop(Exception):
    pass


def test_a_batch_that_fails_between_its_tables_shows_nothing(spark, tmp_dir, monkeypatch):
    root, rows = f"{tmp_dir}/lake", _two_portals()
    frame = lambda r: spark.createDataFrame(r, INC.RAW_SCHEMA)
    INC.ingest_batch(spark, frame(rows), root, "t_000000")
    tables = ("editions", "articles", "relationships")
    state = lambda: {n: sorted(map(str, lake.read_current(spark, root, n).collect())) for n in tables}
    before, late = state(), [rows[2][:5] + (b"second body", 99)]
    real = lake._writer
    for failing in tables:
        def writer(df, parts, obs=None, zstd_level=lake.ZSTD_LEVEL, table="", failing=failing):
            if table == failing:
                raise Stop
            return real(df, parts, obs, zstd_level, table)
        monkeypatch.setattr(lake, "_writer", writer)
        with pytest.raises(Stop):
            INC.ingest_batch(spark, frame(late), root, "t_000001")
        assert state() == before, failing
    monkeypatch.setattr(lake, "_writer", real)
    monkeypatch.setattr(lake, "commit", lambda *a: (_ for _ in ()).throw(Stop()))
    with pytest.raises(Stop):  # all tables are there, the marker is not
        INC.ingest_batch(spark, frame(late), root, "t_000001")
    assert state() == before
    monkeypatch.undo()
    INC.ingest_batch(spark, frame(late), root, "t_000001")
    assert "second body" in str(state()["articles"]) and state()["editions"] != before["editions"]


def test_totals_survive_a_kill_between_batches(spark, tmp_dir, monkeypatch):
    """A run stopped in its third of four batches, after that batch has stored its bodies."""
    rows = _two_portals()
    rows = [r[:5] + (r[5] + b"x" * 3000, r[6]) if r[1] == "content" else r for r in rows]  # bodies out of line
    late = [rows[2][:5] + (b"z" * 4000, 99)]
    for i, g in enumerate((rows[:2], rows[3:], rows[2:3], late)):
        spark.createDataFrame(g, INC.RAW_SCHEMA).coalesce(1).write.parquet(f"{tmp_dir}/land/f{i}")
    whole = INC.run_incremental(spark, f"{tmp_dir}/land", f"{tmp_dir}/a", f"{tmp_dir}/cka", "t")
    totals = lambda root: {k: v for k, v in lake.run_totals(spark, root, "t").items() if "second" not in k and "_per_s" not in k}
    want = totals(f"{tmp_dir}/a")
    assert len(whole) == 4 and want == {k: lake.run_summary(whole)[k] for k in want} and want["content"] == 3 and want["batches"] == 4

    real, calls = lake.commit, []
    def commit(spark_, root, stats):
        calls.append(1)
        if len(calls) == 3:
            raise Stop("killed")
        real(spark_, root, stats)
    monkeypatch.setattr(lake, "commit", commit)
    with pytest.raises(Exception):
        INC.run_incremental(spark, f"{tmp_dir}/land", f"{tmp_dir}/b", f"{tmp_dir}/ckb", "t")
    monkeypatch.undo()
    assert totals(f"{tmp_dir}/b")["batches"] == 2
    seen = INC.ProgressLog()
    again = INC.run_incremental(spark, f"{tmp_dir}/land", f"{tmp_dir}/b", f"{tmp_dir}/ckb", "t", progress=seen)
    assert [s["epoch"] for s in again] == [2, 3] and totals(f"{tmp_dir}/b") == want
    assert {2, 3} <= {b["epoch"] for b in seen.batches} and all(b["rows"] > 0 for b in seen.batches)
    assert totals(f"{tmp_dir}/none")["batches"] == 0


def _phase_file_count(root):
    import os
    return sum(f.endswith(".parquet") for _, _, fs in os.walk(root) for f in fs)


def test_a_late_page_reads_the_buckets_of_its_keys(spark, tmp_dir):
    """200 old batches of other editions; a late page opens a few of their files."""
    root = f"{tmp_dir}/lake"
    n = 200
    old = spark.range(n).select(
        F.lit("m").alias("municipality"), F.format_string("e%d", "id").alias("edition_id"), F.format_string("a%d", "id").alias("article_id"),
        F.format_string("i%d", "id").alias("identifier"), F.lit("t").alias("title"), F.lit("").alias("protocol"), F.lit(0).alias("depth"),
        F.array().cast("array<string>").alias("hierarchy_path"), F.col("id").alias("seq"), F.lit(0).alias("pos"),
        F.format_string("t_%06d", "id").alias("batch_id"))
    for phase in ("links", "edition_links"):  # one file a batch, as `_store` lays them
        (old.select(*INC._columns(phase), INC._bucket(*INC.PHASE_KEYS[phase]).alias("bucket"), "batch_id")
         .write.partitionBy("bucket", "batch_id").parquet(f"{root}/_phases/{phase}"))
        assert _phase_file_count(f"{root}/_phases/{phase}") == n
    assert INC.read_phase(spark, root, "links").count() == n
    key = spark.createDataFrame([("m", "i7")], "municipality string, identifier string")
    late = INC.read_phase(spark, root, "links", key)
    assert [r.edition_id for r in late.collect()] == ["e7"]
    assert len(late.inputFiles()) <= 8 < n
    page = b'<ul id="tree"><li><a class="linkMateria" data-materia-id="9" identificador="i7">t</a></li></ul>'
    staged = INC.Staged(spark, spark.createDataFrame([("m", "structure", "p", "e900", "text/html", page, 900)], INC.RAW_SCHEMA), root)
    assert {r.edition_id for r in INC.touched_editions(spark, root, staged).collect()} == {"e7", "e900"}


def test_existence_test_reads_the_prefixes_of_its_own_hashes(spark, tmp_dir):
    from quire.operators import content as C
    bodies = [(f"k{i}", "text/plain", (f"{i} " * 1500).encode()) for i in range(40)]
    schema = "request_key string, content_type_header string, body binary"
    lake.append_content(spark, C.split_inline(C.dispatch(spark.createDataFrame(bodies, schema))), tmp_dir, "b1")
    one = C.split_inline(C.dispatch(spark.createDataFrame(bodies[:1], schema)))
    prefix = one.first().content_hash[:2]
    found = lake.stored_hashes(spark, tmp_dir, [prefix])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prefix" in plan or f"PartitionFilters: [(prefix#" in plan or "PartitionFilters: [prefix" in plan
    assert f"prefix={prefix}" in plan or prefix in plan.split("PartitionFilters")[1]
    assert 1 <= found.count() < 40
    assert lake.append_content(spark, one, tmp_dir, "b2") == 0 and lake.append_content(spark, one, tmp_dir, "b1") == found.where("batch_id = 'b1'").count()
    assert lake.read_content(spark, tmp_dir, one.select("request_key", "content_hash")).first().content == bodies[0][2]


def _scanned(df):
    """Rows that the file scan handed on: row groups skipped are not among them."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_one_identifier_reads_few_row_groups(spark, tmp_dir):
    """Identifiers without order in dates: statistics cannot skip, the bloom filter can."""
    rows = spark.range(40000).select(
        F.lit("m").alias("municipality"), F.lit(2020).alias("year"), F.lit("b").alias("batch_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 200).cast("int")).alias("publication_date"),
        F.sha2(F.col("id").cast("string"), 256).alias("identifier"))
    parts = ["municipality", "year", "batch_id"]
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = {}
        for table in ("articles", "plain"):
            path = f"{tmp_dir}/{table}"
            lake._writer(rows, parts, table=table).option("parquet.block.size", 64 * 1024).option("parquet.page.size", 4096) \
                .option("parquet.block.size.row.check.min", 100).mode("overwrite").parquet(path)
            one = spark.read.parquet(path).where(F.col("identifier") == F.sha2(F.lit("12345"), 256)).select("publication_date")
            assert one.count() == 1
            counts[table] = _scanned(one)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert counts["articles"] < counts["plain"] / 4, counts


def test_migrate_copies_what_is_missing(spark, tmp_dir, monkeypatch):
    src, dst = f"{tmp_dir}/src", f"{tmp_dir}/dst"
    frame = lambda r: spark.createDataFrame(r, INC.RAW_SCHEMA)
    rows = [r[:5] + (r[5] + b"x" * 3000, r[6]) if r[1] == "content" else r for r in _two_portals()]
    INC.ingest_batch(spark, frame(rows), src, "t_000000")
    real = lake._migrate_table
    def broken(spark_, a, b, name, granularity):
        if name == "relationships":
            raise Stop("interrupted")
        return real(spark_, a, b, name, granularity)
    monkeypatch.setattr(lake, "_migrate_table", broken)
    first = {r["table"]: r for r in lake.migrate(spark, src, dst)}
    assert first["articles"]["copied"] == 2 and not first["relationships"]["ok"]
    monkeypatch.undo()
    second = {r["table"]: r for r in lake.migrate(spark, src, dst)}
    assert second["articles"]["copied"] == 0 and second["relationships"]["copied"] == 2 and all(r["ok"] for r in second.values())
    files = lambda: _phase_file_count(dst)
    n = files()
    assert all(r["copied"] == 0 and r["ok"] for r in lake.migrate(spark, src, dst)) and files() == n
    INC.ingest_batch(spark, frame([rows[2][:5] + (b"y" * 5000, 99)]), src, "t_000001")
    third = {r["table"]: r for r in lake.migrate(spark, src, dst)}
    assert third["articles"]["copied"] == 1 and third["content"]["copied"] >= 1 and third["commits"]["copied"] == 1
    for name in ("editions", "articles", "relationships"):
        a, b = (sorted(map(str, lake.read_current(spark, r, name).collect())) for r in (src, dst))
        assert a == b and a, name
    assert lake.read_table(spark, src, "content").count() == lake.read_table(spark, dst, "content").count() == 3


def test_dry_run_is_one_job_with_one_scan_of_each_input(spark, tmp_dir):
    editions, links, split, _ = INC.parse_landed(spark, spark.createDataFrame(_two_portals(), INC.RAW_SCHEMA))
    paths = {}
    for name, df in (("e", editions), ("l", links), ("s", split)):
        df.write.parquet(f"{tmp_dir}/{name}")
        paths[name] = spark.read.parquet(f"{tmp_dir}/{name}")
    corpus = INC._assemble(spark, paths["e"], paths["l"], paths["s"])
    assert lake.dry_run(corpus) == {"editions": 2, "articles": 2, "relationships": 2, "orphans": 0}
    plan = corpus.counted(lake.Observation()).editions._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.strip(" :+-").startswith("Relation [") for line in plan.splitlines()) == 3


def test_empty_phases_keep_editions(spark, sf_small, tmp_dir):
    """R5 + D6: a batch whose structure and content phases are empty still yields its
    editions (zero articles) and nothing else."""
    landing = f"{tmp_dir}/landing"
    land_from_driver(spark, sf_small, landing, n_batches=1)
    landed = spark.read.schema(INC.RAW_SCHEMA).option("recursiveFileLookup", "true").parquet(landing)
    meta_only = landed.where(F.col("phase") == "metadata")
    corpus, _ = INC.process_landed(spark, meta_only)
    n_meta = meta_only.count()
    assert corpus.editions.count() == n_meta
    assert corpus.editions.where(F.col("total_articles") != 0).count() == 0
    assert corpus.articles.count() == 0
    empty = landed.limit(0)
    corpus2, _ = INC.process_landed(spark, empty)
    assert corpus2.editions.count() == 0 and corpus2.articles.count() == 0
