"""DataFrame operators. Canonical columns: ``doc_id``, ``term``, ``tf``, ``w``."""
