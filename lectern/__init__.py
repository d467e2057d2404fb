"""Lectern: long-form text preparation, identity, quality and roll-ups as Spark DataFrame operators."""
