"""Operators for training-data pipelines. Nothing else in weftlake imports this subpackage."""
