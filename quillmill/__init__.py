"""quillmill: Spark-first analytics over text generations, revisions and the corpora behind them."""
