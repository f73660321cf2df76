"""Operators over fields on structured meshes."""
