"""Query of the tokenizer alignment. SQL has no tokenizers: it is tested against a plain version."""

from pyspark.sql import functions as F

from kerbside.llm.q_dedup import documents
from kerbside.llm.registry import query
from kerbside.llm.token_alignment import align


@query("op13_token_alignment")
def _(spark, sf):
    out = align(documents(spark, sf))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return out.withColumn("groups_sha256", digest).drop("groups")
