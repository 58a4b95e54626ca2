"""The links of all documents of sf0.01 against every pair of them."""

from collections import Counter, defaultdict

from lakesift.llm import queries

SF = "/root/testdata/sf0.01"


def test_query_is_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    own = sorted(set(texts.values()))
    sets, held, shared = [], defaultdict(list), Counter()
    for text in own:
        w = text.encode().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for i, s in enumerate(sets):
        for gram in s:
            for j in held[gram]:
                shared[j, i] += 1
            held[gram].append(i)
    links = Counter()
    for (i, j), n in shared.items():
        if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
            links[own[i]] += 1
            links[own[j]] += 1
    found = {r["doc_id"]: r["n_links"] for r in queries.op2_ngram_jaccard_join(spark, SF).collect()}
    assert found == {d: links[t] for d, t in texts.items()} and sum(links.values()) == 8
