import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secret_scans", "packing"]


def test_run(spark, tmp_path):
    rows, labels = [], []
    for i in range(400):
        text = " ".join(f"w{(i * 31 + k * 7 + k * k) % 997:03d}x" for k in range(40)).replace("0", "a").replace("1", "b")
        text = "".join(chr(97 + ord(c) % 26) if c.isdigit() else c for c in text)
        if i % 4 == 0:
            words = text.split()
            text = " ".join([*words[: i % 30], "grobian", *words[i % 30 :], "grobian"])
        rows.append((i, text, "en", f"src{i}", len(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    item = " ".join(f"bench{chr(97 + k % 26)}{chr(97 + k * 5 % 26)} of it" for k in range(20))
    rows += [(1001, rows[1][1], "en", "copy", 1), (1002, f"intro words {item} and an end", "en", "leak", 2), (1003, "the key: password=abcdefghijklmnop here", "en", "key", 3), (1004, None, None, None, None), (1005, "", "en", "x", 0)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i in range(400) if i % 4 == 0}
    gone = toxic - kept["toxicity"].keys()
    assert len(gone) >= 0.9 * len(toxic) and len(kept["toxicity"].keys() - toxic) == 300 + 5
    assert kept["toxicity"].keys() - kept["near_dedup"].keys() == {1001}
    assert kept["near_dedup"].keys() - kept["decontamination"].keys() == {1002}
    assert kept["secret_scans"].keys() == kept["decontamination"].keys()
    changed = {i for i, t in kept["secret_scans"].items() if t != kept["decontamination"][i]}
    assert changed == {1003} and kept["secret_scans"][1003] == "the key: password=<secret> here"
    packed = corpus_pipeline.pack(spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == kept["secret_scans"].keys()
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(packed)
