"""All queries of this subpackage, the pipeline's included."""
import corpus_pipeline

from .queries import ORACLE as _oracle, QUERIES as _queries

QUERIES = {**_queries, "pipeline": corpus_pipeline.run}
ORACLE = {**_oracle, **({} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL})}
