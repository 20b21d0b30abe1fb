"""The T-SQL dialect: text to tokens, tokens to a tree, the tree to Spark SQL."""
