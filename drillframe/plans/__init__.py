"""Whole pipelines out of the operators: cleaning, tops, features, retrospective, benchmarks, model."""
