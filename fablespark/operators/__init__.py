"""Relational operators over documents, chapters, segments, clips and projects."""
