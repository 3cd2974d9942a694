"""Reading and writing snapshots, parameterised SQL, exports."""
