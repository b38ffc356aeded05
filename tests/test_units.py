import random

from pyspark.sql import functions as F

from evispark.operators.units import HATCH, SPEED, common_units, file_key, told, unit_calibration

COLUMNS = "row_id long, source_file string, hatch_spacing_um double, scan_speed_mm_s double, laser_power_w double, layer_thickness_um double, am_process string, evidence_text string, unit string"


def test_what_texts_tell():
    h, v = told(HATCH), told(SPEED)
    assert h("hatch 0.1 mm", 0.1) == "mm"
    assert h("hatch 0.1 mm", 100.0) == "um"  # the stored number decides
    assert h("pas de hachure 2,874 thou", 2.874) == "mil"
    assert h("h = 0,152 mm, v = 1970 mm s-1", 152.0) == "um"
    assert h("columns: v (ips), h (um)", None) == "um" and v("columns: v (ips), h (um)", 50.0) == "in/s"
    assert v("v = 1,720 mm/s", 1720.0) == "mm/s" and v("speed: 1.685metres per second", 1.685) == "m/s"
    assert v(None, 3.0) is None and v("", 3.0) is None and v("see Table 3", 3.0) is None


def made(seed, tell):
    """Files of one unit each; a share of their rows tells it."""
    rng = random.Random(seed)
    factors = {u: f for u, f, _ in HATCH.units if u != "nm"}
    rows, n = [], 0
    for file in range(240):
        unit = rng.choice(["um"] * 5 + list(factors))
        for k in range(8):
            um = float(rng.randint(60, 180))
            x = float(f"{um / factors[unit]:.5g}")
            text = f"hatch {x:g} {unit}" if rng.random() < tell(file) else None
            rows.append((n, f"Dir/F{file}.PDF" if k % 2 else f"f{file}.pdf.pdf", x, float(rng.randrange(200, 2500, 5)), 280.0, 40.0, "L-PBF", text, f"{unit} {int(um)}"))
            n += 1
    return rows


def test_held_out_files(spark, scratch):
    """Units of files whose texts tell nothing are learnt from the others; what is converted with confidence is right."""
    df = spark.createDataFrame(made(1, lambda file: 0.0 if file % 4 == 0 else 0.7), COLUMNS)
    done = common_units(df, scratch).where("field_name = 'hatch_spacing_um'").join(df.select("row_id", "source_file", F.split("unit", " ").alias("true"), "evidence_text"), "row_id").collect()
    silent = [r for r in done if int(r.source_file.lower().split("f", 1)[1].split(".")[0].split("/f")[-1].lstrip("f") or 0) % 4 == 0]
    sure = [r for r in done if r.how != "review"]
    assert len(silent) > 300 and len(sure) > 0.9 * len(done)
    right = sum(r.unit == r.true[0] and r.value_common == int(r.true[1]) for r in sure)
    assert right >= 0.97 * len(sure)
    assert all(r.value_common is None for r in done if r.how == "review")


def test_edges(spark, scratch):
    rows = [
        (1, "a.pdf", 0.1, None, None, None, None, "hatch 0.1 mm", None), (2, "A.PDF.pdf", 0.12, float("nan"), None, None, None, None, None),
        (3, None, 100.0, 900.0, None, None, None, None, None), (3, None, 100.0, 900.0, None, None, None, None, None), (4, "b.pdf", float("nan"), 0.0, None, None, None, "x" * 100_000, None),
    ]
    got = {(r.row_id, r.field_name): (r.unit, r.value_common) for r in common_units(spark.createDataFrame(rows, COLUMNS), scratch).collect()}
    assert got[1, "hatch_spacing_um"] == got[2, "hatch_spacing_um"] == got[3, "hatch_spacing_um"] == (None, None)  # too little to learn from
    assert (2, "scan_speed_mm_s") not in got and (4, "hatch_spacing_um") not in got
    assert common_units(spark.createDataFrame([], COLUMNS), scratch).count() == 0
    key = spark.createDataFrame([(" data\\raw\\X.pdf.PDF ",), ("",), (None,)], "f string").select(file_key(F.col("f")).alias("k")).collect()
    assert [r.k for r in key] == ["x.pdf", None, None]


def test_the_forest_decides(spark, scratch, monkeypatch):
    """Without it nothing is converted; files whose texts tell nothing are converted by it; texts only audit it."""
    df = spark.createDataFrame(made(2, lambda file: 0.0 if file % 3 == 0 else 0.6), COLUMNS)
    done = common_units(df, scratch).where("field_name = 'hatch_spacing_um'").cache()
    by = {(r.how, r.audit): r.n for r in done.groupBy("how", "audit").agg(F.count("*").alias("n")).collect()}
    assert by.get(("learnt", "silent"), 0) > 400 and by.get(("learnt", "agrees"), 0) > 800
    assert not any(how == "learnt" and audit == "differs" for how, audit in by)
    bins = unit_calibration(df, scratch).where("field_name = 'hatch_spacing_um'").collect()
    assert sum(r.n_files for r in bins) > 20 and all(0 <= r.share_right <= 1 for r in bins)
    monkeypatch.setattr("evispark.operators.units._likely", lambda *a: None)
    assert {(r.unit, r.how) for r in common_units(df, scratch).collect()} == {(None, "review")}
