"""The pipeline language: text to a tree, the tree to Spark columns where it can be, else evaluated document by document."""
