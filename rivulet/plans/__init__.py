"""Named query plans: each is a (spark, sf_dir) -> DataFrame function and,
where SQL can express it, the equivalent DuckDB SQL used as an oracle."""
