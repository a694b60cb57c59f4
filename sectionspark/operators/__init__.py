"""DataFrame to DataFrame operators: chunking, tables, joins, ranking, evaluation."""
