"""Transactional log-structured table: protocol, writer, snapshots, indexing, services."""
