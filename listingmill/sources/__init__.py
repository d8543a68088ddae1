"""Readers and writers: messages, snapshots, CSV, verdict logs; exports of the same."""
