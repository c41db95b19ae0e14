"""Hand-sized cases, round trips and brute force for what SQL in DuckDB does not cover."""

import itertools

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.functions import bases, names
from seqloom.operators import alignment, curate, genomes, graph, hits, resolve, supermatrix
from seqloom.sources import files

HSP = "query_acc string, subject_acc string, hsp_id string, q_start int, q_end int, s_start int, s_end int, alignment_length int, n_identity int, bit_score double"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize(
    "location, gene",
    [
        ("complement(join(1..3,7..9))", "CCCTTT"),
        ("join(complement(1..3),7..9)", "TTTGGG"),
        ("join(complement(7..9),complement(1..3))", "CCCTTT"),
        ("join(1..3, 7..9)", "AAAGGG"),
        ("complement(<1..3)", "TTT"),
        ("5", "C"),
        ("order(complement(10..>12),1..2)", "AAAAA"),
        ("complement(order(1..2,complement(7..8)))", "GGTT"),
    ],
)
def test_splicing(spark, location, gene):
    f = spark.createDataFrame([("g", location)], "genome string, location string")
    s = spark.createDataFrame([("g", "aaacccgggttt")], "genome string, seq string")
    assert genomes.spliced(f, s).first().seq == gene


def chained(spark, *hsps, limit=1000):
    made = [("q", "s", f"h{n}", *h) for n, h in enumerate(hsps)]
    return hits.chain(spark.createDataFrame(made, HSP), limit, F.lit(limit)).first()


def test_chain_needs_the_same_shift_at_both_ends(spark):
    seed = (100, 200, 1100, 1200, 101, 90, 50.0)
    r = chained(spark, seed, (100, 260, 1100, 1260, 161, 80, 40.0))  # begins with the seed and ends later
    assert (r.hits_num, r.s_end) == (1, 1200)
    r = chained(spark, seed, (300, 350, 1050, 1090, 51, 40, 30.0))  # after it on the query, before it on the subject
    assert r.hits_num == 1
    r = chained(spark, seed, seed[:6] + (49.0,))  # the same place again
    assert (r.hits_num, r.sum_hits_alignlen) == (2, 202)


def test_chain_query_ends_follow_the_subject(spark):
    seed = (100, 200, 1100, 1200, 101, 90, 50.0)
    r = chained(spark, seed, (210, 300, 1210, 1300, 91, 80, 40.0), (250, 600, 1250, 1290, 41, 30, 20.0))
    assert (r.q_end, r.s_end, r.hits_num) == (300, 1300, 3)


def test_chain_on_the_minus_strand(spark):
    seed = (100, 200, 5200, 5100, 101, 90, 50.0)
    r = chained(spark, seed, (210, 300, 5090, 5000, 91, 80, 40.0), (10, 90, 5300, 5210, 81, 70, 30.0), (10, 90, 5000, 4900, 81, 70, 20.0))
    assert (r.q_start, r.q_end, r.s_start, r.s_end, r.hits_num, r.s_strand) == (10, 300, 5300, 5000, 3, False)
    assert chained(spark, seed, (90, 10, 5300, 5210, 81, 70, 30.0)).hits_num == 1  # the query's other strand


def test_chain_leaves_out_what_does_not_fit(spark):
    r = chained(spark, (100, 200, 1100, 1200, 101, 90, 50.0), (800, 900, 1900, 2300, 101, 90, 40.0), (300, 400, 1300, 1400, 101, 90, 30.0), limit=600)
    assert (r.s_start, r.s_end, r.q_end, r.hits_num) == (1100, 1400, 400, 3)


@pytest.mark.parametrize("conservative", [True, False])
def test_sum_of_pairs(spark, conservative):
    aln = spark.createDataFrame([("g", "1", "arN-A"), ("g", "2", "CYAAA"), ("g", "3", "-YA--")], "g string, accession string, seq string")
    want = 0.0
    for column in ("AC", "RYY", "NAA", "A", "AA"):
        for x, y in itertools.combinations(column, 2):
            want += bases.equality(x, y) or (-2 if conservative else -1)
    got = alignment.sum_of_pairs(aln, "g", conservative).first().sp_score
    assert abs(got - (want - 2)) < 1e-9  # one inner gap is opened; those at the ends cost nothing


def test_lower_case_counts(spark):
    aln = spark.createDataFrame([("g", "1", "acgt"), ("g", "2", "ACGT"), ("g", "3", "aCg-")], "g string, accession string, seq string")
    assert alignment.consensus(aln, "g").first().consensus == "ACGT"


def test_base_equality_by_meaning():
    for x, y in itertools.product(bases.IUPAC, repeat=2):
        a, b, e = set(bases.IUPAC[x]), set(bases.IUPAC[y]), bases.equality(x, y)
        assert e == bases.equality(y, x)
        if x == y:
            assert e == 1 / len(a)
        elif min(len(a), len(b)) == 1 and not a & b:
            assert e == 0
        elif len(a) == 1 or len(b) == 1:
            assert e == 1 / max(len(a), len(b))
        else:
            assert e == (0.25 if "N" in (x, y) else 0)


def test_kmers_drop_and_expand(spark):
    seqs = {"a": "ACGTACGTNN", "b": "acgtRcgt", "c": "ACGTACGTNN", "d": "TT"}
    df = spark.createDataFrame(list(seqs.items()), "accession string, seq string")

    def cut(s, how, k=4):
        s = s.upper()
        if how == "drop":
            s = "".join(c for c in s if c in "ACGT")
        out = [s[i : i + k] for i in range(len(s) - k + 1)]
        return [x for m in out for x in map("".join, itertools.product(*(bases.IUPAC[c] for c in m)))]

    for how in ("drop", "expand"):
        pairs, members = alignment.kmer_similarity(df, 4, how)
        assert dict(rows(members)) == {"a": "a", "b": "b", "c": "a", "d": "d"}
        x, y = cut(seqs["a"], how), cut(seqs["b"], how)
        shared = sum(min(x.count(m), y.count(m)) for m in set(x))
        assert rows(pairs) == [("a", "b", shared, shared / min(len(x), len(y)))]


def test_p_distance_with_copies(spark):
    seqs = {"a": "AAAAAAAAAA", "b": "AAAAAAAACC", "c": "AAAAAAAAAA", "d": "CCCCCCCCCC", "e": "AAAAAAAACC"}
    df = spark.createDataFrame([("g", k, s) for k, s in seqs.items()], "g string, accession string, seq string")
    want = sorted(("g", x, y, d) for x, y in itertools.combinations(seqs, 2) if (d := sum(p != q for p, q in zip(seqs[x], seqs[y], strict=True)) / 10) <= 0.3)
    assert rows(alignment.p_distance_edges(df, "g")) == want


def test_average_identity_counts_copies(spark):
    seqs = ["ACRT", "ACGT", "ACRT", "----", "ACG-"]
    df = spark.createDataFrame([("g", str(i), s) for i, s in enumerate(seqs)], "g string, accession string, seq string")
    each = spark.createDataFrame(list(itertools.combinations(seqs, 2)), "a string, b string").select(alignment.identity(F.col("a"), F.col("b")).alias("pi"))
    got = alignment.average_identity(df, "g").first()
    assert got.n_pairs == 10 and abs(got.avg_pi - each.agg(F.avg("pi")).first()[0]) < 1e-12


def by_matrix(n, edges):
    """The same clustering on a dense matrix."""
    m = np.eye(n)
    for a, b in edges:
        m[a, b] = m[b, a] = 1
    m /= m.sum(0)
    for _ in range(100):
        new = np.linalg.matrix_power(m, 2) ** 2
        new /= new.sum(0)
        new = np.where((new >= 1e-3) | (new == new.max(0)), new, 0)
        done = abs(new - m).max() <= 1e-8 + 1e-5 * new.max()
        m = new
        if done:
            break
    return [min(i for i in range(n) if m[i, i] > 0 and m[i, j] > 0) for j in range(n)]


@pytest.mark.parametrize("dense", [graph.DENSE, 0])
def test_markov_clusters_against_a_matrix(spark, dense):
    rng = np.random.default_rng(4)
    n, edges = 24, {(a, b) for a, b in rng.integers(0, 20, (34, 2)).tolist() if a < b}
    e = spark.createDataFrame([("g", f"{a:02}", f"{b:02}") for a, b in edges], "graph_id string, i string, j string")
    nodes = spark.createDataFrame([("g", f"{a:02}") for a in range(n)] + [("h", "alone")], "graph_id string, i string")
    got = {(r.graph_id, r.node): r.cluster for r in graph.markov_clusters(e, nodes, dense=dense).collect()}
    assert got == {("g", f"{j:02}"): f"{c:02}" for j, c in enumerate(by_matrix(n, edges))} | {("h", "alone"): "alone"}


def test_cluster_representatives(spark):
    clusters = spark.createDataFrame([("g", "a", "a"), ("g", "b", "a"), ("g", "c", "c")], "graph_id string, node string, cluster string")
    lengths = spark.createDataFrame([("a", 5), ("b", 9), ("c", 1)], "accession string, n int")
    assert {r.accession for r in graph.cluster_representatives(clusters, lengths, "accession", [F.desc("n")]).collect()} == {"b", "c"}


def test_average_rank_by_ranges(spark):
    values = [3, 1, 3, 7, 7, 7, 2, 9] * 5 + list(range(10, 400))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id int, x double").repartition(3)
    for down in (True, False):
        got = {r.id: r.r for r in curate.average_rank(df, "x", down, "r", buckets=7).collect()}
        order = sorted(values, reverse=down)
        want = {i: np.mean([k + 1 for k in (order.index(v), len(order) - 1 - order[::-1].index(v))]) for i, v in enumerate(values)}
        assert got == want


def test_mining_stops(spark):
    per = {1: ["a", "b", "c"], 2: ["b", "d"], 3: ["d", "e"], 4: ["f"]}

    def find(n, found):
        assert (found is None) == (n == 1)
        return spark.createDataFrame([(x,) for x in per[n]], "subject_acc string") if n in per else None

    everything = lambda **k: {(r.subject_acc, r.source_round) for r in hits.mined(find, F.lit(True), **k).collect()}
    assert everything(expected=100, few=1) == {("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 3), ("f", 4)}
    assert everything(expected=100, few=2) == {("a", 1), ("b", 1), ("c", 1), ("d", 2), ("e", 3)}  # twice fewer than two
    assert everything(expected=3, few=1) == {("a", 1), ("b", 1), ("c", 1), ("d", 2)}  # over 1.2 * 3


def test_places_and_radius(spark):
    rng = np.random.default_rng(6)
    made = [("q", "s", f"h{i:03}", int(x), int(y), 1, 2, 3, 4, 5.0) for i, (x, y) in enumerate(rng.integers(0, 400, (120, 2)) // 20 * 20)]
    h = hits.place_classes(spark.createDataFrame(made, HSP))
    one = h.where("hsp_id = place")
    got = {(r.i, r.j) for r in hits.radius_edges(one, F.lit(1000), 0.1).collect()}
    first = {}
    for m in made:
        first.setdefault(m[3:5], m)
    want = {(a[2], b[2]) for a, b in itertools.combinations(first.values(), 2) if (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 100**2}
    assert got == want and {(r.hsp_id, r.place) for r in h.collect()} == {(m[2], first[m[3:5]][2]) for m in made}


def test_supermatrix_refuses(spark):
    cols = "marker string, taxon string, seq string"
    good = spark.createDataFrame([("m", "a", "AC"), ("m", "b", "AG"), ("n", "a", "T"), ("n", "b", "C")], cols)
    assert supermatrix.refuse_uneven(good).count() == 4
    for bad in (good.where("not (marker = 'n' and taxon = 'b')"), good.withColumn("seq", F.when(F.col("taxon") == "a", "A").otherwise(F.col("seq"))), good.unionByName(good.limit(1))):
        with pytest.raises(ValueError):
            supermatrix.refuse_uneven(bad)
    uneven = spark.createDataFrame([("m", "a", "AC"), ("m", "b", "A"), ("n", "c", "TT"), ("o", "c", "")], cols)
    assert rows(supermatrix.completed(uneven)) == [("a", "m", "AC"), ("a", "n", "--"), ("b", "m", "A"), ("b", "n", "--"), ("c", "m", "---"), ("c", "n", "TT")]


def test_phylip_and_partitions(spark, tmp_path):
    m = spark.createDataFrame([("b", "AC-T"), ("a", "ACGT")], "taxon string, seq string")
    supermatrix.phylip_lines(m).coalesce(1).write.text(str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == [" 2  4", "a ACGT", "b AC-T"]
    with pytest.raises(ValueError):
        supermatrix.phylip_lines(m.unionByName(m.select("taxon", F.lit("A").alias("seq"))))
    p = spark.createDataFrame([("m1", 1, 9)], "marker string, start long, end long")
    assert [r.line for r in supermatrix.partition_lines(p).collect()] == ["DNA, m1 = 1-9"]


def test_fasta_round_trip(spark, tmp_path):
    recs = spark.createDataFrame([("m1", "a|x", "ACGT"), ("m1", "b", ""), ("m2", "c d", "TT")], "marker string, header string, seq string")
    files.write_fasta(recs, str(tmp_path / "f"), "marker")
    back = files.fasta(spark, str(tmp_path / "f" / "*" / "*.txt")).select("header", "seq")
    assert rows(back) == [("a|x", "ACGT"), ("b", ""), ("c d", "TT")]


def test_tables_lists_and_rejects(spark, tmp_path):
    t = spark.createDataFrame([("a", 1, None), ("b", None, "short")], "accession string, n int, reject_reason string")
    kept, gone = files.split_rejects(t)
    assert rows(kept) == [("a", 1)] and rows(gone) == [("b", None, "short")]
    for sep in (",", "\t"):
        files.write_table(t, str(tmp_path / f"t{ord(sep)}"), sep)
        assert rows(files.table(spark, str(tmp_path / f"t{ord(sep)}"), "accession string, n int, reject_reason string", sep)) == rows(t)
    (tmp_path / "acc.txt").write_text("X1\n\n X2 \n")
    assert rows(files.accession_list(spark, str(tmp_path / "acc.txt"))) == [("X1",), ("X2",)]
    assert rows(curate.counted(t)) == [(2, 1, 1)]


def test_marker_parameters(spark, tmp_path):
    (tmp_path / "ITS.txt").write_text("target_region\tITS\nkey_annotations\tinternal transcribed spacer|ITS1; ITS2,5.8S\nmax_length\t3000\n")
    r = files.marker_parameters(spark, str(tmp_path / "*.txt")).first()
    assert r.file == "ITS.txt" and r.params["key_annotations"] == ["internal transcribed spacer", "ITS1", "ITS2", "5.8S"] and r.params["max_length"] == ["3000"]


def test_hit_xml(spark, tmp_path):
    hsp = "<Hsp><Hsp_bit-score>{}</Hsp_bit-score><Hsp_evalue>1e-5</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>9</Hsp_query-to><Hsp_hit-from>20</Hsp_hit-from><Hsp_hit-to>12</Hsp_hit-to><Hsp_identity>8</Hsp_identity><Hsp_gaps>0</Hsp_gaps><Hsp_align-len>9</Hsp_align-len></Hsp>"
    body = f"<Hit><Hit_id>gi|1|gb|AB1.1|</Hit_id><Hit_def>one &gt;gi|2|gb|AB2.1| two &gt;short def</Hit_def><Hit_accession>AB1</Hit_accession><Hit_hsps>{hsp.format(50)}{hsp.format(40)}</Hit_hsps></Hit>"
    (tmp_path / "R7_XML.txt").write_text(f"<BlastOutput><Iteration_hits>{body}</Iteration_hits></BlastOutput>")
    got = files.hit_xml(spark, str(tmp_path / "*_XML.txt")).collect()
    assert {r.hit_def for r in got} == {"one", "gi|2|gb|AB2.1| two"} and {r.bit_score for r in got} == {50.0, 40.0} and len(got) == 4
    assert {(r.rid, r.q_start, r.s_start, r.s_end, r.n_identity) for r in got} == {("R7", 1, 20, 12, 8)}


def test_pending_and_merging(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "subject_acc string")
    assert rows(hits.pending(ids("a", "b", "c"), ids("a"), ids("c"))) == [("b",)]
    old = spark.createDataFrame([("g", ["x"], "linear", "1", "k"), ("h", ["y"], "linear", "2", "k")], "genome string, features array<string>, topology string, date string, keywords string")
    new = spark.createDataFrame([("g", ["z"], "circular", None)], "genome string, features array<string>, topology string, date string")
    got = {r.genome: (r.features, r.topology, r.date, r.keywords) for r in genomes.merged_annotations(old, new).collect()}
    assert got == {"g": (["z"], "circular", "1", "k"), "h": (["y"], "linear", "2", "k")}


def test_names_and_small_functions(spark):
    aliases = spark.createDataFrame([("rbcl", "rbcL"), ("maturase K", "matK")], "gene_alias string, gene string")
    f = spark.createDataFrame([("rbcl", "maturase K"), ("ycf9", None), (None, "maturase K"), (None, "odd")], "gene_alias string, product string")
    assert sorted(r.gene for r in genomes.named_gene(f, aliases).collect()) == ["matK", "rbcL", "unknown", "ycf9"]
    q = spark.sql("SELECT map('organelle', array('plastid'), 'country', array()) AS m, cast(null AS string) AS n, '' AS e")
    r = q.select(names.picked(F.col("m"), "organelle").alias("a"), names.picked(F.col("m"), "country").alias("b"), names.picked(F.col("m"), "x", "none").alias("c"), (names.content_key(F.col("n")) != names.content_key(F.col("e"))).alias("d")).first()
    assert tuple(r) == ("plastid", "unknown", "none", True)
    left, right = hits.reference_shortfall(F.lit("--ACG-N"))
    assert tuple(spark.range(1).select(left, right).first()) == (2, 2)
    b = spark.createDataFrame([("Rosa a", "Rosa a", "species", "Accepted"), ("Rosa b", "Rosa a", "species", "Synonym")], "name string, accepted_name string, accepted_rank string, status string")
    assert rows(resolve.synonyms(b, "Rosa a")) == [("Rosa b",)]


def test_query_set_needs_two(spark):
    q = spark.createDataFrame([("1", "h", "AC"), ("2", "h", "AG"), ("3", "i", "AC")], "accession string, header string, seq string")
    with pytest.raises(ValueError):
        curate.query_set(q)
    assert curate.query_set(q.unionByName(q.selectExpr("'9' accession", "'z' header", "'TT' seq").limit(1))).count() == 2


def test_quality_flags(spark):
    f = spark.createDataFrame([("g", "CDS", "a"), ("g", "CDS", "b"), ("h", "CDS", "a")], "genome string, type string, gene string")
    s = spark.createDataFrame([("g", "ACGN"), ("h", "ACGT"), ("i", "")], "genome string, seq string")
    got = {r.genome: (r.n_cds, r.unclear_ratio, r.flagged) for r in genomes.quality(genomes.feature_counts(f, 2), s, 0.2).collect()}
    assert got == {"g": (2, 0.25, True), "h": (1, 0.0, True), "i": (0, 0.0, True)}
    assert not genomes.quality(genomes.feature_counts(f, 2), s, 0.3).where("genome = 'g'").first().flagged


def test_duplicate_policies_and_lengths(spark):
    d = spark.createDataFrame([("a", "x", 5), ("b", "x", 9), ("c", "y", 4)], "accession string, organism string, length int")
    assert sorted(r.accession for r in curate.without_duplicates(d, "organism").collect()) == ["b", "c"]
    assert [r.accession for r in curate.without_duplicates(d, "organism", "skip").collect()] == ["c"]
    with pytest.raises(ValueError, match="x"):
        curate.without_duplicates(d, "organism", "error")
    assert curate.without_duplicates(d.where("length < 9"), "organism", "error").count() == 2
    assert {r.accession: r.longer for r in curate.length_split(d, "organism").collect()} == {"a": False, "b": True, "c": True}
    s = spark.createDataFrame([("A--C",)], "seq string").select(curate.long_enough(F.col("seq"), 3).alias("a"), curate.long_enough(F.col("seq"), 3, False).alias("b")).first()
    assert tuple(s) == (False, True)


def test_common_ends_of_first_rows(spark):
    aln = spark.createDataFrame([("g", "1", "-ACGT"), ("g", "2", "AACG-"), ("g", "3", "---G-")], "g string, accession string, seq string")
    assert tuple(alignment.common_ends(aln, "g").first())[1:] == (4, 5)
    assert tuple(alignment.common_ends(aln, "g", 2).first())[1:] == (2, 5)


def test_markers_of_many_files(spark, tmp_path):
    (tmp_path / "ITS.fasta").write_text(">A1.1:5-9|Rosa_alba|x\nACGT\n")
    (tmp_path / "rbcL.fasta").write_text(">B2.1|Rosa_canina\nTT\n>B3.1 plain\nGG\n")
    got = rows(files.markers(spark, str(tmp_path / "*.fasta")).drop("header"))
    assert got == [("ITS", "A1.1", "Rosa_alba", "ACGT"), ("rbcL", "B2.1", "Rosa_canina", "TT"), ("rbcL", "B3.1", "B3.1 plain", "GG")]


def test_aligned_places(spark):
    s = F.lit("A-ACC-TG-G")
    r = spark.range(1).select(*(bases.aligned_place(s, F.lit(n), left).alias(f"{n}{left}") for n, left in ((5, True), (1, False), (3, False), (9, True), (0, True)))).first()
    assert tuple(r) == (7, 10, 7, None, None)


def test_extension_headers(spark):
    recs = spark.createDataFrame([("a", "a:100-107|x", "A----CGTACGT"), ("b", "b:50-53|y", "ACGT"), ("c", "c:10-17_reverse_complement|z", "ACGTAC----GT")], "accession string, header string, seq string")
    found = spark.createDataFrame([("a", 101, 107), ("c", 15, 10)], "accession string, s_start int, s_end int")
    got = rows(alignment.extension_controlled(recs, found))
    assert got == [("a", "a:101-107|x", "CGTACGT"), ("b", "b:50-53|y", "ACGT"), ("c", "c:10-15_reverse_complement|z", "ACGTAC")]


def test_published_looks_for_a_part(spark):
    said = {"Plant J. 1": True, "Unpublished (2019)": False, "Published Only in Database (2005) In press": False, "UNKNOWN": False, " ": False, None: False}
    got = spark.createDataFrame(list(said.items()), "j string, w boolean").select("w", names.published(F.col("j")).alias("p"), names.published(F.col("j"), missing=True).alias("m"), "j").collect()
    assert all(r.p == r.w for r in got) and all(r.m == (r.w or not (r.j or "").strip()) for r in got)


CHOICE = "organism string, accession string, sum_of_rank double, consensus_value double, specimen_voucher string, journal string, date date"


@pytest.mark.parametrize(
    ("steps", "want"),
    [(curate.STEPS, "a2"), (("voucher", "published", "newest"), "c"), (("published", "newest"), "d"), (("newest",), "e"), ((), "a"), (("voucher",), "b"), (("published",), "c"), (("consensus", "newest"), "a2")],
)
def test_each_step_of_the_choice(spark, steps, want):
    day = lambda n: __import__("datetime").date(2000, 1, n)
    rows_ = [
        ("o", "a", 1.0, 0.9, "unknown", "unpublished", day(1)), ("o", "a2", 1.0, 0.9, None, "Unpublished (2019)", day(2)), ("o", "b", 2.0, None, "V1", "Unknown", day(3)), ("o", "c", 3.0, 1.0, "V2", "Plant J.", day(4)),
        ("o", "d", 4.0, 1.0, " UNKNOWN", None, day(5)), ("o", "e", 5.0, 1.0, "", "published only in database", day(6)),
    ]
    assert curate.representatives(spark.createDataFrame(rows_, CHOICE), steps).first().accession == want
    with pytest.raises(ValueError, match="steps"):
        curate.representatives(spark.createDataFrame(rows_, CHOICE), ("oldest",))


def test_words_of_the_choice_are_parameters(spark):
    rows_ = [("o", "a", 1.0, 1.0, "none", "thesis", None), ("o", "b", 2.0, 1.0, "V", "x", None)]
    df = spark.createDataFrame(rows_, CHOICE)
    assert curate.representatives(df, ("voucher",)).first().accession == "a"
    assert curate.representatives(df, ("voucher",), blank=("none",)).first().accession == "b"
    assert curate.representatives(df, ("published",), unpublished=("thesis",)).first().accession == "b"


def test_no_rank_without_a_value(spark):
    df = spark.createDataFrame([("a", 3, 10, 1), ("b", None, 20, 1), ("c", 5, None, 2)], "id string, sum_hits_score int, record_length int, source_round int")
    got = {r.id: (r.rank_score, r.rank_length, r.sum_of_rank) for r in curate.ranked(df).collect()}
    assert got == {"a": (2.0, 2.0, 4.0), "b": (None, 1.0, 1.0), "c": (1.0, None, 1.0)}


def test_length_in_ranking_leaves_out_ambiguity_codes(spark):
    rec = spark.createDataFrame([("a", "o", "ACGTNNNNNN"), ("b", "o", "ACGTACGT--")], "accession string, organism string, seq string")
    hit = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 1)], "accession string, sum_hits_score double, source_round int")
    assert {r.accession: r.record_length for r in curate.evaluated(rec, hit).collect()} == {"a": 4, "b": 8}


def test_consensus_of_one_record_is_itself(spark):
    aln = spark.createDataFrame([("g", "1", "--Ac-"), ("h", "1", "---"), ("h", "2", "---")], "g string, accession string, seq string")
    assert rows(alignment.consensus(aln, "g").select("g", "consensus")) == [("g", "--Ac-"), ("h", "NNN")]


def test_genes_of_a_genome(spark):
    features = [("g", "gene", "rbcL", None, "1..9"), ("g", "CDS", "RBCL", "large", "join(1..3,7..9)"), ("g", "tRNA", "rbcL", None, "1..2"), ("g", "CDS", None, "atp B", "complement(1..3)"), ("g", "rRNA", "odd", None, "2..3"), ("g", "CDS", None, None, "4..5"), ("g", "CDS", "rbcL", None, "join(1..3,7..9)"), ("none", "CDS", "rbcL", None, "1..2")]
    f = spark.createDataFrame(features, "genome string, type string, gene_alias string, product string, location string")
    aliases = spark.createDataFrame([("rbcL", "rbcL"), ("RBCL", "rbcL"), ("atp B", "atpB")], "gene_alias string, gene string")
    seqs = spark.createDataFrame([("g", "aaacccggg")], "genome string, seq string")
    got = genomes.gene_sequences(genomes.known_genes(f, aliases), seqs)
    assert rows(got) == [("atpB", "g", "g|complement(1..3)", "TTT"), ("rbcL", "g", "g|join(1..3,7..9)", "AAAGGG")]
    table = f.withColumn("start_pos", F.lit(1)).withColumn("end_pos", F.lit(4)).withColumn("gene", F.lit("x")).where("genome = 'g'")
    assert genomes.gene_table(table).first().n == 5


def test_journals_that_contain_unpublished_go(spark, tmp_path):
    refs = "".join(f"REFERENCE   {k}\n  JOURNAL   {j}\n" for k, j in enumerate(("Unpublished (2019)", "Plant J. 1", "Submitted, Unpublished"), 1))
    (tmp_path / "x.gb").write_text(f"LOCUS       X1   4 bp    DNA     PLN 05-MAR-2020\nACCESSION   X1\n{refs}FEATURES             Location/Qualifiers\nORIGIN\n        1 acgt\n//\n")
    assert files.genbank(spark, str(tmp_path / "x.gb")).first().journals == ["Plant J. 1"]


def test_matrix_to_files_and_back(spark, tmp_path):
    m = spark.createDataFrame([("m1", "Rosa alba", "AC-T"), ("m1", "Rosa canina", "AC-A"), ("m2", "Rosa alba", "GG-")], "marker string, taxon string, seq string")
    joined, parts = supermatrix.matrix(m, m, gt=0.5)
    supermatrix.write_matrix(joined, parts, str(tmp_path / "out"))
    text = lambda name: "".join(p.read_text() for p in sorted((tmp_path / "out" / name).glob("part*")))
    assert text("phylip") == " 2  5\nRosa_alba ACTGG\nRosa_canina ACA--\n"
    assert text("partitions").splitlines() == ["DNA, m1 = 1-3", "DNA, m2 = 4-5"] and text("codons").splitlines()[4] == "DNA, m2_pos2 = 5-5\\3"
    assert sorted(map(tuple, files.fasta(spark, str(tmp_path / "out/fasta")).select("header", "seq").collect())) == [("Rosa_alba", "ACTGG"), ("Rosa_canina", "ACA--")]
    with pytest.raises(ValueError, match="aligned"):
        supermatrix.write_matrix(joined.unionByName(spark.createDataFrame([("x", "A")], joined.schema)), parts, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


def test_all_columns_of_an_extension(spark):
    r = hits.extend(spark.createDataFrame([(11, 90, 500, 401)], "q_start int, q_end int, s_start int, s_end int"), F.lit(120), 130, 4, 6).first()
    assert (r.hit_len, r.max_extension, r.auto_extension_left, r.auto_extension_right, r.extra_extension_left, r.extra_extension_right) == (100, 30, 10, 30, 4, 6)
    assert (r.extension_left, r.extension_right) == (8, 21) and (r.q_extstart, r.q_extend, r.s_extstart, r.s_extend) == (3, 111, 508, 380)
