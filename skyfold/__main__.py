from skyfold.commands import main

main()
