"""Readers and writers for flow files, flow-table documents and model bundles."""
