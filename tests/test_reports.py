"""Headlines in several scripts, run documents and their rejects, label sheets, and the bootstrap beside numpy."""

import hashlib
import random

import numpy as np
import pytest

from shocklens.operators import evaluate, reports
from shocklens.sources import landing

REPORTS = [
    "SOFTS - Coffee prices jump nearly 7 % in New York after stocks drawn", "Coffee tumbles most since 2008 as Brazil frost concerns ease", "Café fecha em forte alta com problemas de embarques e frio no Brasil",
    "Giá cà phê hôm nay 1 / 12 : Đồng loạt tăng mạnh , Robusta thêm gần trăm USD / tấn", "Les prix à terme du café Arabica affichent la plus forte hausse depuis 10 ans", "Café recua em meio à venda na bolsa", "أسعار القهوة ترتفع في بورصة", "커피 가격 급등", "Цена кофе: вырос фьючерс", "咖啡 期货 上涨",
]
OTHERS = ["Spinelli Coffee reportedly ceasing operations in Singapore", "Lavazza unveils new organic coffee collection", "Coffee prices up 5% at supermarkets", "The guide to coffee in Kyoto", "", None, "   "]


def _scores(spark, titles, market="coffee", cues=None):
    docs = spark.createDataFrame([(i, t, market, 99) for i, t in enumerate(titles)], "i int, title string, market string, report_score int")
    return [r.report_score for r in reports.report_scores(docs, cues).orderBy("i").collect()]


def test_reports_score_above_shop_news(spark):
    assert all(s >= 3 for s in _scores(spark, REPORTS)) and all(s < 3 for s in _scores(spark, OTHERS))
    assert _scores(spark, REPORTS[:1])[0] >= 6 and _scores(spark, OTHERS)[4:] == [0, 0, 0]


def test_no_direction_counts_more(spark):
    pairs = [("Coffee prices jump 7% in New York", "Coffee prices plunge 7% in New York"), ("Café sobe 5% na bolsa", "Café cai 5% na bolsa"), ("Giá cà phê tăng mạnh", "Giá cà phê giảm mạnh"), ("Arabica futures settle higher", "Arabica futures settle lower"), ("커피 급등", "커피 급락")]
    up, down = (_scores(spark, [p[k] for p in pairs]) for k in (0, 1))
    assert up == down


def test_cues_of_another_market_do_not_count(spark):
    assert _scores(spark, ["Wheat bushel"], "wheat") == [3] and _scores(spark, ["Wheat bushel"], "coffee") == [0] and _scores(spark, ["Wheat prices fell", None], "tin") == [3, 0]
    own = reports.cue_table(spark, [("tin", "name", "en", "word", "Tin Ore"), ("tin", "report", "en", "stem", "leap"), ("*", "price", "de", "part", "kurs"), ("tin", "odd", "en", "word", "x"), ("tin", "name", "en", "word", "")])
    assert _scores(spark, ["tin ore leaping", "Tin leaped", "Silberkurse x", "tin, ore"], "tin", own) == [3, 2, 1, 1]


def test_every_run_document_is_a_run_or_a_reject(spark, tmp_path):
    good = '{"pipeline_version": "11",\n "anomaly": {"date": "2020-01-02", "direction": "up"}, "outcome": {"tier": "EXPLAINED_STRONG"}}'
    files = {"coffee_2020-01-02": good, "coffee_2020-01-03": "{broken", "coffee_2020-01-04": "", "coffee_2020-01-05": good.replace('"direction"', '"pct_move": "much", "direction"'), "coffee_2020-01-06": "{}", "wheat_2020-01-07": good.replace("2020-01-02", "soon"), "wheat_2020-01-08": "[1, 2]"}
    for name, text in files.items():
        (tmp_path / f"pipeline_output_{name}.json").write_text(text)
    runs, rejects = landing.scanned_runs(spark, str(tmp_path / "pipeline_output_*.json"))
    kept = runs.collect()
    lost = {r.file.rsplit("_", 1)[1][:10]: r.reason for r in rejects.collect()}
    assert [(r.series, str(r.day), r.tier) for r in kept] == [("coffee", "2020-01-02", "EXPLAINED_STRONG")]
    assert lost == {"2020-01-03": "not a JSON object", "2020-01-04": "empty file", "2020-01-05": "a field of another type", "2020-01-06": "no day", "2020-01-07": "no day", "2020-01-08": "not a JSON object"}
    assert landing.stored_runs(spark, str(tmp_path / "pipeline_output_*.json")).count() == 1


def test_label_sheet_keeps_labels_and_empty_columns(spark, tmp_path):
    old = spark.createDataFrame([("1", "d", "yes"), ("2", "d", ""), ("3", "d", "no")], "document_id string, anomaly_date string, human_label string")
    new = spark.createDataFrame([("1", "d", 'a "quoted",\ntext ', 0.123456, "kept?"), ("2", "d", None, None, None), ("4", "d", "x" * 400, 1.0, None)], "document_id string, anomaly_date string, text string, keyword_score double, human_label string")
    landing.write_label_sheet(landing.label_sheet(new, old), str(tmp_path / "s"))
    back = landing.read_sheet(spark, str(tmp_path / "s"))
    rows = {r.document_id: r for r in back.collect()}
    assert tuple(back.columns) == landing.LABEL_SHEET and set(rows) == {"1", "2", "3", "4"}
    assert rows["1"].text_snippet == 'a "quoted", text ' and rows["1"].keyword_score == "0.1235" and rows["1"].url == ""
    assert {k: r.human_label for k, r in rows.items()} == {"1": "yes", "2": "", "3": "no", "4": ""} and len(rows["4"].text_snippet) == 300


@pytest.mark.parametrize("seed", [11, 12])
def test_bootstrap_equals_numpy(spark, seed):
    rng = random.Random(seed)
    data = [(rng.randrange(12) / 10 if rng.random() < 0.95 else None, rng.random() < 0.4, f"g{rng.randrange(9)}") for _ in range(300)]
    got = evaluate.bootstrap_auc(spark.createDataFrame(data, "score double, relevant boolean, grp string").repartition(3), "grp", 120, seed).first()
    steps, groups, aucs = evaluate.poisson_steps(), sorted({g for _, _, g in data}), []
    drawn = []
    for sample in range(1, 121):
        times = {g: sum(int(hashlib.md5(f"{seed}|{sample}|{g}".encode()).hexdigest()[:15], 16) >= t for t in steps) for g in groups}
        drawn += times.values()
        p = np.array([s for s, r, g in data if s is not None and r for _ in range(times[g])])
        n = np.array([s for s, r, g in data if s is not None and not r for _ in range(times[g])])
        if len(p) and len(n):
            aucs.append(((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / len(p) / len(n))
    assert got.samples == len(aucs) and got.lo == pytest.approx(np.percentile(aucs, 2.5)) and got.hi == pytest.approx(np.percentile(aucs, 97.5))
    assert abs(np.mean(drawn) - 1) < 0.12 and abs(np.var(drawn) - 1) < 0.25
