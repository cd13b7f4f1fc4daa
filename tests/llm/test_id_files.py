"""How token ids are read back."""

import public_tokenizers

from eocatalog.llm import _common, token_ids


def test_token_ids_are_read_by_one_python_step(spark, docs):
    path = _common.new_path(spark, "test-ids")
    shards = token_ids.write_ids(docs, public_tokenizers.path("byte_bpe_50k.json"), path, shard_docs=40)
    plan = token_ids.read_digests(shards, path)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    both = zip(token_ids.read_digests(shards, path).orderBy("start").collect(), token_ids.read_ids(shards, path).orderBy("start").collect(), strict=True)
    assert all((a.doc_id, a.n_tokens) == (b.doc_id, len(b.ids) // 4) for a, b in both)
