"""Fixtures worked out by hand, exact identities, and the soundness of audits."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from umbra import session
from umbra.audit import compare, descent, sumtree
from umbra.audit.memo import Memo
from umbra.functions import encoding, ring64
from umbra.operators import attribution, discovery, dummies, match, mpc, noise, private_join, shares, sketch
from umbra.operators.party import PartySpec, check_parameters, load_config, validate
from umbra.protocol import encrypted_match, p256, paillier
from umbra.sources import csv_tables
from umbra.streaming import streams

SENDER = [(i, a, b, i + 1) for i, (a, b) in enumerate(zip("chegyz", "*#&@%!", strict=True))]
RECEIVER = [(i, a, b, i + 1) for i, (a, b) in enumerate(zip("bceg", "#*&!", strict=True))]


def parties(spark):
    s = spark.createDataFrame(SENDER, "row_id long, id_0 string, id_1 string, f long")
    r = spark.createDataFrame(RECEIVER, "row_id long, id_0 string, id_1 string, g long")
    return s, r


def test_waterfall_toy(spark):
    got = {tuple(x) for x in match.waterfall_match(*parties(spark), ["id_0", "id_1"]).collect()}
    assert got == {(0, 1, 0), (2, 2, 0), (3, 3, 0), (1, 0, 1)}


def test_join_with_dummies_keeps_the_sum(spark):
    s, r = parties(spark)
    specs = PartySpec(("id_0", "id_1"), ("f",)), PartySpec(("id_0", "id_1"), ("g",))
    joined = private_join.private_join(s, r, *specs, {"tau": 5}, {"tau": 7, "zero_column": -1})
    row = joined.agg(F.sum("g"), F.count(F.lit(1)), F.count_if(F.col("s_row").startswith("dummy"))).first()
    assert row[0] == 10 and row[1] == 4 + row[2]
    assert private_join.sum_check(private_join.joined_shares(joined, ["f", "g"], "x"), "g").first()[0] == 10


def test_attribution_toy(spark):
    rows = [(0, 0.1, 2.0, 2.0), (1, 0.03, 0.3, 0.3), (2, 4.0, 4.0, 4.0), (3, 2.0, 0.1, 0.1)]
    j = spark.createDataFrame(rows, "row_no long, t0 double, t1 double, value double")
    assert attribution.attribution(j, 5.0).first()["attributed"] == pytest.approx(2.3)
    assert attribution.attribution_fixed(j, 5.0).first()["attributed"] == 2.29998779296875
    assert attribution.attribution_shared(j, 5.0, "s").first()["attributed"] == 2.29998779296875


def test_empty_parties(spark):
    s, r = parties(spark)
    assert match.waterfall_match(s.limit(0), r, ["id_0", "id_1"]).count() == 0
    assert attribution.attribution(spark.createDataFrame([], "t0 double, t1 double, value double"), 1.0).first()["attributed"] == 0.0


def test_duplicate_ids_are_refused(spark):
    s, _ = parties(spark)
    with pytest.raises(ValueError):
        validate(s.unionByName(s), PartySpec(("id_0",)))


def test_parameters():
    good = load_config({"ids_num": 3})
    check_parameters(good, good)
    for bad in ({"ids_num": 0}, {"ids_num": 101}, {"tau": (1 << 20) + 1}, {"n_bits": 512}, {"curve": "P-521"}, {"use_precomputed_tau": False}):
        with pytest.raises(ValueError):
            check_parameters(load_config(bad))
    with pytest.raises(ValueError):
        check_parameters(good, load_config({"ids_num": 3, "sigma": 50}))
    assert dummies.tau_lookup(10_000, 2, 10, 3) == 954
    with pytest.raises(ValueError):
        dummies.tau_lookup(10**8, 2, 10, 3)


def test_dummy_blocks(spark):
    tau, ids = 6, ["id_0", "id_1", "id_2"]
    a, b = (dummies.dummy_rows(spark, ids, ["f"], tau, p, "seed", 0).collect() for p in "sr")
    assert len(a) == len(b) == 3 * tau
    for i, c in enumerate(ids):
        assert sum(r[c].startswith("common:") for r in a) == tau
        assert {r["row_id"] for r in a if r[c].startswith("common:")} == {f"dummy-s-{j}" for j in range(i * tau, (i + 1) * tau)}
    assert all(r["f"] == 0 for r in a)


def test_ring_and_shares(spark):
    values = [0, 1, -1, 2**63 - 1, -(2**63), 12345]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "row_no long, v long")
    assert [r["v"] for r in shares.reveal(shares.share(df, ["v"], "k"), ["v"]).orderBy("row_no").collect()] == values
    added = df.select(ring64.signed(ring64.add(F.col("v"), F.lit(1))).alias("x")).collect()
    assert [r["x"] for r in added] == [((v + 1 + 2**63) % 2**64) - 2**63 for v in values]
    assert [r[0] for r in df.select(shares.sign_bit(F.col("v"))).collect()] == [int(v < 0) for v in values]


def test_kernels_on_shares(spark):
    values = [0, 1, -1, 2**62, -(2**62), 12345, -777]
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in values for b in values)]
    df = spark.createDataFrame(rows, "row_no long, x long, y long")
    word = lambda v: (v + 2**63) % 2**64 - 2**63
    xor = mpc.xor_shared(df, ["x", "y"], "k")
    got = mpc.added(mpc.conjunction(xor, [("x", "y", "z")], "k"), "x", "y", "s", "k").select("row_no", mpc.xor_open("z").alias("z"), mpc.xor_open("s").alias("s")).collect()
    for r in got:
        _, x, y = rows[r["row_no"]]
        assert (r["z"], r["s"]) == (x & y, word(x + y))
    w = mpc.wide(shares.share(df, ["x", "y"], "k"), ["x", "y"])
    w = mpc.less(mpc.greater(w, "x", "y", "gt", "k"), "x", 12345, "lt", "k")
    got = mpc.chosen(w, "gt", "y", "c", "k").collect()
    for r in got:
        _, x, y = rows[r["row_no"]]
        near = abs(x - y) < 2**63
        assert not near or (r["gt_0"] ^ r["gt_1"], word(r["c_0"] + r["c_1"])) == (int(x > y), y if x > y else 0)
        assert r["lt_0"] ^ r["lt_1"] == int(x < 12345)
    # a party's shares of the results look random: no column of one party tells bits or values
    assert len({r["c_0"] for r in got}) == len(got) and {r["gt_0"] for r in got} == {0, 1} == {r["gt_1"] for r in got}


def test_shared_attribution_opens_no_column(spark, monkeypatch):
    """Neither party's inputs, comparisons or contributions are put together; only sums are."""
    monkeypatch.setattr(shares, "reveal", lambda *a, **k: pytest.fail("opened"))
    monkeypatch.setattr(shares, "reveal_doubles", lambda *a, **k: pytest.fail("opened"))
    rows = [(i, float(i % 7), float(i % 7 + i % 5), 10.0 + i) for i in range(40)]
    held = shares.share_doubles(spark.createDataFrame(rows, "row_no long, t0 double, t1 double, value double"), ["t0", "t1", "value"], "s")
    out = attribution.contributions(held, 3.0, "s").groupBy("row_no").pivot("party", [0, 1]).agg(F.first("s_c")).collect()
    for r in out:
        t0, t1, value = rows[r["row_no"]][1:]
        assert (int(r["0"]) + int(r["1"])) % 2**64 == (int(value * 65536) if 0 < t1 - t0 < 3 else 0)
        assert int(r["0"]) not in (0, int(value * 65536)) and int(r["1"]) not in (0, int(value * 65536))


def test_private_measurement_toy(spark):
    s = spark.createDataFrame([(i, a, b, t) for i, (a, b, t) in enumerate(zip("chegyz", "*#&@%!", [0.1, 2.0, 0.03, 4.0, 0.5, 0.6], strict=True))], "row_id long, id_0 string, id_1 string, t0 double")
    r = spark.createDataFrame([(i, a, b, t, t) for i, (a, b, t) in enumerate(zip("bceg", "#*&!", [0.1, 2.0, 0.3, 4.0], strict=True))], "row_id long, id_0 string, id_1 string, t1 double, value double")
    assert attribution.private_measurement(s, r, ["id_0", "id_1"], 5.0, "x", tau=4).first()["attributed"] == 2.29998779296875


def test_waterfall_joins_do_not_grow(spark, monkeypatch):
    """Three joins a round, however many rounds came before."""
    ids, plans = [f"id_{i}" for i in range(7)], []
    real = match.cut
    monkeypatch.setattr(match, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or real(df))
    rows = [(i, *[f"{i}-{c}" if i == c else f"{i}-{c}-s" for c in range(7)]) for i in range(9)]
    s = spark.createDataFrame(rows, "row_id long, " + ", ".join(f"{c} string" for c in ids))
    r = s.select("row_id", *[F.regexp_replace(c, "-s$", "-r").alias(c) for c in ids])
    assert sorted(x[:] for x in match.waterfall_match(s, r, ids).collect()) == [(i, i, i) for i in range(7)]
    assert max(plans) <= 3


def test_sketch_draws_are_uniform(spark):
    """Every cell but the true one is drawn equally often, and none twice in a report."""
    p = sketch.SketchParams(k=2, m=12, s=4, p=0.5)
    m = spark.range(6000).select(F.col("id").alias("client_id"), F.lit("v").alias("message"))
    x = [set(r["x"]) for r in sketch.privatize(m, p, "u").where("j = 0").collect()]
    assert all(len(r) == 4 and r <= set(range(12)) for r in x)
    share = sorted(sum(c in r for r in x) / len(x) for c in range(12))
    assert abs(share[-1] - 0.5) < 0.04 and all(abs(v - p.q) < 0.04 for v in share[:-1])


def test_encodings(spark):
    df = spark.createDataFrame([("abc", [1, 70000, 255])], "m string, xs array<long>")
    r = df.select(
        *[encoding.hash_encode(F.col("m"), F.lit(7), m).alias(f"h{m}") for m in (1024, 1000, 999983)],
        encoding.deserialize_ints(encoding.serialize_ints(F.col("xs"), 3), 3).alias("xs"),
        F.hex(encoding.sha3_256(F.col("m"))).alias("sha3"),
        F.hex(encoding.bool_pack(F.array(*[F.lit(bool(b)) for b in (1, 0, 1, 0, 0, 0, 0, 0, 1)]))).alias("bits"),
        F.hex(encoding.token_truncate(F.unhex(F.lit("00" * 21 + "0102030405060708090A0B0C")))).alias("token"),
    ).first()
    assert (r["h1024"], r["h1000"], r["h999983"]) == (666, 650, 206606)
    assert r["xs"] == [1, 70000, 255] and r["bits"] == "0501" and r["token"] == "0102030405060708090A0B0C"
    assert r["sha3"] == "3A985DA74FE225B2045C172D6BD390BD855F086E3E9D525B46BFE24511431532"


def test_noise(spark):
    trials = noise.binomial_trials(1.0, 1e-5)
    assert trials == 98
    a = spark.range(4000).select(noise.binomial_noise(trials, "t", F.col("id")).alias("x")).agg(F.avg("x"), F.var_pop("x")).first()
    assert abs(a[0]) < 4 * (trials / 4 / 4000) ** 0.5 and abs(a[1] - trials / 4) < 3
    b = noise.shared_bits_noise(spark.range(2000).withColumnRenamed("id", "row_no"), trials, "t").agg(F.avg("noise"), F.var_pop("noise")).first()
    assert abs(b[0]) < 0.5 and abs(b[1] - trials / 4) < 4
    t, s = noise.stability_parameters(0.1, 1 / 1750)
    assert t == pytest.approx(68.7422, abs=1e-3) and s == 10
    c = spark.range(4000).select(noise.laplace_noise(2.0, "t", F.col("id")).alias("x")).agg(F.avg("x"), F.avg(F.abs("x"))).first()
    assert abs(c[0]) < 0.2 and abs(c[1] - 2) < 0.2


def test_sketch_is_unbiased(spark):
    p = sketch.SketchParams(k=32, m=64, s=8, p=0.5)
    assert sketch.SketchParams().epsilon == pytest.approx(2.849880, abs=1e-5)
    m = spark.range(1750).select(F.col("id").alias("client_id"), F.when(F.col("id") < 1000, "123").when(F.col("id") < 1500, "456").otherwise("789").alias("message"))
    m = m.unionByName(spark.createDataFrame([(9999, None)], "client_id long, message string"))
    reports = sketch.privatize(m, p, "t")
    assert reports.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x"))).first()[:] == (1750, 8, 8)
    est = {r["message"]: r["est"] for r in sketch.estimate(sketch.build(reports), spark.createDataFrame([(1750,)], "n long"), m.select("message").dropna().distinct(), p).collect()}
    assert abs(est["123"] - 1000) < 250 and abs(est["789"] - 250) < 250


def test_discovery_releases_the_common(spark):
    m = spark.range(2000).select(F.col("id").alias("client_id"), F.when(F.col("id") < 1900, "often").otherwise(F.concat(F.lit("rare"), F.col("id").cast("string"))).alias("message"))
    assert [r["message"] for r in discovery.discover(m, 0.1, 1e-5, "t", "0123456789abcdef", "fedcba9876543210").collect()] == ["often"]


def test_csv_round_trip(spark, tmp_path):
    rows = [("id1", 'a"b', Decimal(1), Decimal(4)), ("id2", "", Decimal(2), Decimal(2**64 - 1))]
    df = spark.createDataFrame(rows, "k0 string, k1 string, f0 decimal(20,0), f1 decimal(20,0)")
    path = str(tmp_path / "t")
    csv_tables.sink_keyed_csv(df.coalesce(1), path, header=True)
    back = csv_tables.scan_keyed_csv(spark, path, ["k0", "k1"], ["f0", "f1"], header=True)
    assert sorted(back.collect()) == sorted(df.collect())
    assert csv_tables.csv_shape(spark, path, header=True).first()[:] == (2, 4)


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("", (), {"sc": lambda self: type("", (), {"getCheckpointDir": lambda self: type("", (), {"isEmpty": lambda self: True})()})()})()
        getConf = staticmethod(dict)

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(type("", (), {"sparkContext": Context()})())


def test_cut_forgets_estimates(spark):
    """A loop of joins and checkpoints keeps the plans' size estimates from growing."""
    df = spark.range(50).withColumn("v", F.col("id") % 7)
    sizes = []
    for _ in range(6):
        df = session.cut(df.join(df.select(F.col("id").alias("v"), F.col("v").alias("w")), "v").select("id", F.col("w").alias("v")))
        sizes.append(len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
    assert df.count() == 50 and sizes[-1] == sizes[0]


def test_memo():
    m = Memo()
    assert [m.calls(8, c) for c in range(9)] == [0, 3, 5, 6, 7, 6, 5, 3, 0]
    assert [round(float(m.best(20, 10, t)[0]), 6) for t in range(1, 5)] == [1.0, 2.473684, 3.69969, 5.057037]


@pytest.mark.parametrize("budget", [0, 1, 3, 7, 15, 40])
def test_audits_are_sound(budget):
    x, y = set(range(24)), set(range(12, 40))
    for seed in range(8):
        rng = random.Random(seed)
        for policy in (descent.BASELINE, descent.IMPROVED, descent.dynamic(Memo())):
            members, others = descent.audit(x, y, budget, policy, rng)
            assert members <= x & y and others <= x - y
        members, others = sumtree.audit(x, y, budget, rng=rng)
        assert members <= x & y and others <= x - y


def test_sum_tree_resolves_all():
    """With queries enough every element is resolved, in parts where the whole can't be enumerated."""
    x, y = set(range(24)), set(range(12, 40))
    for computation in (1e10, 1e3):
        assert sumtree.audit(x, y, 200, computation) == (x & y, x - y)
    assert sumtree.audit(set(), y, 5) == (set(), set()) and sumtree.audit(x, set(), 5) == (set(), x)
    assert sumtree.n_sum_pairs([("a", 1), ("b", 2), ("c", 1), ("d", 3)], 3, 2) == [[("a", 1), ("b", 2)], [("c", 1), ("b", 2)]]


def test_audit_curve_grows(spark):
    rows = compare.leakage_curve(spark, list(range(12)), list(range(6, 20)), [0, 12, 30], 6, ("improved", "dynamic")).collect()
    by = {(r["algo"], r["tau"]): r["leak"] for r in rows}
    assert by["improved", 0] == 0 and by["improved", 30] == 12 and by["dynamic", 12] <= 12


def test_n_sum():
    assert sumtree.n_sum([1, 2, 3, 4, 5], 6, 2) == [[1, 5], [2, 4]]


def test_protocol_equals_semantics(spark):
    keys = p256.private_keys("t", 2)
    df = spark.createDataFrame([("a@b.c",), ("x@y.z",)], "m string")
    one = df.select(F.hex(p256.encrypt(p256.hash_encrypt(F.col("m"), keys[0]), keys[1])).alias("e")).collect()
    two = df.select(F.hex(p256.encrypt(p256.hash_encrypt(F.col("m"), keys[1]), keys[0])).alias("e")).collect()
    again = df.select(F.hex(p256.rekey(p256.hash_encrypt(F.col("m"), keys[0]), keys[1], keys[0])).alias("e")).collect()
    direct = df.select(F.hex(p256.hash_encrypt(F.col("m"), keys[1])).alias("e")).collect()
    assert one == two and again == direct and one[0] != one[1]


def test_encrypted_match_equals_the_clear_one(spark):
    s, r = (p.drop("f", "g") for p in parties(spark))
    got = encrypted_match.encrypted_match(s, r, ["id_0", "id_1"], "a", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, match.waterfall_match(s, r, ["id_0", "id_1"]).collect()))
    t = encrypted_match.tokens(s.withColumn("id_1", F.col("id_0")), ["id_0", "id_1"], [5, 7], [11, 13]).collect()
    assert all(len(x["id_0"]) == 24 and x["id_0"] != x["id_1"] for x in t)


def test_paillier(spark):
    key = paillier.generate(512, "t")
    a, b = paillier.encrypt(key.n, 5, 12345), paillier.encrypt(key.n, 7, 54321)
    assert paillier.decrypt(key, paillier.add(key.n, a, b)) == 12
    assert paillier.decrypt(key, paillier.multiply(key.n, paillier.add_plain(key.n, a, 3), 4)) == 32
    assert paillier.Key.deserialize(key.serialize()) == key
    values = [1, 2**64 - 1, 7]
    df = spark.createDataFrame([([str(v) for v in values],)], "f array<string>")
    r = df.select(paillier.share_features(F.col("f"), key, "s").alias("s")).first()["s"]
    assert [(int(x) + int(y)) % 2**64 for x, y in zip(r["owner"], r["other"], strict=True)] == values


def test_streams(spark, tmp_path):
    p = sketch.SketchParams(k=4, m=16, s=3, p=0.5)
    rows = spark.range(40).select(F.col("id").alias("client_id"), F.concat(F.lit("m"), (F.col("id") % 3).cast("string")).alias("message"))
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.start_sketch(source, p, "t", "running_sketch", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    batch = sketch.build(sketch.privatize(rows, p, "t"))
    assert sorted(spark.table("running_sketch").collect()) == sorted(batch.collect())
