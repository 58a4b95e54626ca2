"""Replies to many prompts: one request for equal ones, none for those that are kept."""

import os

import pytest
from pyspark.sql import functions as F

from lakesift.blocks import materialise
from lakesift.operators import ingest, prompts, search
from lakesift.providers import CannedWriter, HashingEmbedder, Writer
from lakesift.schema import Chunking, Search, Settings
from lakesift.store import Store

T, LATER = "2024-05-01 10:00:00", "2024-06-01 10:00:00"


def logged(folder):
    """A model that writes a file for each request."""
    class Logged(Writer):
        name = "logged"

        def reply(self, prompt, most_tokens=512):
            import os
            import uuid

            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
            return prompt.upper()

    return Logged()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_equal_prompts_are_sent_once(spark, store, tmp_path):
    (tmp_path / "log").mkdir()
    sent, model = (lambda: len(os.listdir(tmp_path / "log"))), logged(str(tmp_path / "log"))
    rows = spark.createDataFrame([(k, f"prompt {k % 5}", "x") for k in range(40)] + [(40, None, "x"), (41, "", "x"), (41, "", "x")], "query_id long, prompt string, key string")
    found = prompts.replies(store, rows, model, T)
    assert sorted((r["query_id"], r["reply"]) for r in found.where("query_id <> 40").collect()) == sorted((r["query_id"], r["prompt"].upper()) for r in rows.collect() if r["prompt"] is not None)
    assert found.where("query_id = 40 and reply is null").count() == 1 and sent() == 6
    more = rows.where("query_id < 5").unionByName(spark.createDataFrame([(99, "new", "x")], rows.schema))
    assert prompts.replies(store, more, model, LATER).count() == 6 and sent() == 7
    assert search.ask(store, model, "prompt 3", LATER) == "PROMPT 3" and sent() == 7  # one cache for one prompt and for many
    assert prompts.replies(store, rows.where("false"), model, T).count() == 0 and sent() == 7
    assert store.table("cache").count() == store.table("cache").select("hash").distinct().count() == 7


def test_a_task_that_is_run_again_asks_for_nothing_that_was_stored(spark, tmp_path):
    for name in ("log", "replies"):
        (tmp_path / name).mkdir()
    folder, mark = str(tmp_path / "log"), str(tmp_path / "failed")

    class Fails(Writer):
        name = "fails"

        def reply(self, prompt, most_tokens=512):
            import os
            import uuid

            if prompt == "p7" and not os.path.exists(mark):
                open(mark, "w").close()
                raise RuntimeError("lost")
            open(os.path.join(folder, f"{prompt}-{uuid.uuid4().hex}"), "w").close()
            return prompt + "!"

    rows = materialise(spark.createDataFrame([(f"k{k}", f"p{k}") for k in range(10)], "key string, prompt string").coalesce(1), "prompts")
    with pytest.raises(Exception, match="lost"):
        prompts.asked(rows, Fails(), str(tmp_path / "replies"), in_flight=2).collect()
    assert {x.split("-")[0] for x in os.listdir(folder)} >= {"p0", "p1", "p2", "p3", "p4", "p5"}
    found = prompts.asked(rows, Fails(), str(tmp_path / "replies"), in_flight=2).collect()
    assert sorted((r["key"], r["reply"]) for r in found) == sorted((f"k{k}", f"p{k}!") for k in range(10))
    times = [x.split("-")[0] for x in os.listdir(folder)]
    assert all(times.count(f"p{k}") == 1 for k in (0, 1, 2, 3, 4, 5, 7, 8, 9))  # only those that were in flight are sent again


def test_requests_are_made_again(monkeypatch):
    monkeypatch.setattr(prompts, "PAUSE", 0)

    class Shaky(Writer):
        name, times = "shaky", 0

        def reply(self, prompt, most_tokens=512):
            self.times += 1
            if self.times < 3:
                raise ConnectionError("no answer")
            return "well"

    assert prompts._reply(Shaky(), "x", 3) == "well"
    with pytest.raises(ConnectionError):
        prompts._reply(Shaky(), "x", 2)


def test_what_is_looked_for(spark, store):
    rows = spark.createDataFrame([(1, "what is a fox?"), (2, "red fox"), (3, None), (4, "  "), (5, "why not"), (6, "unknown")], "query_id long, query string")
    model = CannedWriter({"is a fox": "A fox is an animal.", "red fox": "vixen\n\n  crimson canine \r\nreynard\nfourth\nfifth"})
    found = {r["query_id"]: (r["kind"], r["words"], r["asked"]) for r in prompts.widened(store, rows, model, T).collect()}
    assert found == {1: ("hyde", "what is a fox?", "A fox is an animal."), 2: ("rephrase", "red fox vixen crimson canine reynard fourth", "red fox"), 3: ("none", "", ""), 4: ("none", "  ", "  "),
                     5: ("hyde", "why not", "why not"), 6: ("rephrase", "unknown", "unknown")}


def test_search_of_many_with_a_model(spark, store):
    texts = ["The vixen lives in the wood and hunts at night.", "A kettle boils water in the kitchen.", "Ships sail over the sea to far lands."]
    files = spark.createDataFrame([(f"{k}.md", "u", t, T) for k, t in enumerate(texts)], "path string, source_uri string, text string, modified_at string").withColumn("modified_at", F.col("modified_at").cast("timestamp"))
    settings = Settings(chunking=Chunking(200, 20, 5), search=Search(bm25_threshold=2.0))
    ingest.add_documents(store, files, "default", T)
    ingest.index_documents(store, HashingEmbedder(), settings, T)
    rows = spark.createDataFrame([(1, "fox"), (2, "how does one make tea?")], "query_id long, query string")
    model = CannedWriter({"Query: fox": "vixen", "make tea": "A kettle boils water."})
    find = lambda **x: {(r["query_id"], r["place"]): r for r in search.search_many(store, rows, HashingEmbedder(), settings, reranker=False, count=1, context=False, now=T, **x).collect()}
    plain, wide = find(), find(model=model)
    assert plain[1, 1]["bm25_rank"] is None and wide[1, 1]["bm25_rank"] == 1 and wide[1, 1]["excerpt"] == texts[0]
    assert wide[2, 1]["vector_rank"] == 1 and wide[2, 1]["excerpt"] == texts[1]
    assert store.table("cache").where("type = 'llm'").count() == 2
    one = search.search(store, "how does one make tea?", HashingEmbedder(), T, settings, model=model, reranker=False, count=1, context=False)
    assert one[0]["excerpt"] == texts[1] and store.table("cache").where("type = 'llm'").count() == 2
