"""Column functions over names, probe figures and identities."""
