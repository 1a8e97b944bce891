"""Readers and writers of track files at directory scale: a file is a track, a row is a point."""
