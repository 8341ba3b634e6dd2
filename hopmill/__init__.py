"""hopmill: Spark jobs for building, checking and scoring multi-hop question-answering benchmark data."""
